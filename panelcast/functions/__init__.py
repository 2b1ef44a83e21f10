"""Column expressions: dates, numbers, text, metrics."""
