"""Column functions: text, JSON, arrays and maps, vectors."""
