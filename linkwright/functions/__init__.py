"""Column functions: text normalisation, keys and similarity."""
