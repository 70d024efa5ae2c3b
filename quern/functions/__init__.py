"""Column functions: text, vectors, JSON and rule models."""
