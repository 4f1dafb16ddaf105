"""Column functions: text, JSON, arrays and vectors."""
