"""Column expressions: text cleaning, null-safe numbers, indices and bands."""
