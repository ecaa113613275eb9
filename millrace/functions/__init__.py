"""Column expressions: aggregates over samples, and arithmetic with IEEE results."""
