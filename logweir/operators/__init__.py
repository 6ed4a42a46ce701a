"""Search, aggregation, fetching, projection and inspection over a log table."""
