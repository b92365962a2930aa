"""Column functions: text, numbers in text, vectors, JSON."""
