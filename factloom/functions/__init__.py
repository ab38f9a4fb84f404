"""Column expressions: printed values, periods, names and texts."""
