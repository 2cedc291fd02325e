"""Column expressions: parsing, normalisation, and report text."""
