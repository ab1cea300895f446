"""Column expressions: numbers, dates, labels, metrics and display formats."""
