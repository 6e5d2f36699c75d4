"""Column expressions and small relational helpers."""
