"""Column expressions: tokens, numbers, times and ids."""
