"""Column functions: text normalisation, hashing and vector arithmetic."""
