"""Field mappings, bulk input, and the stored log table."""
