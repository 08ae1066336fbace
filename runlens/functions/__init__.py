"""Column expressions: parsing, labels, comparisons and vector arithmetic."""
