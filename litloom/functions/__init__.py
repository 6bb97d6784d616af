"""Column expressions: text normalisation, cited references, derived fields."""
