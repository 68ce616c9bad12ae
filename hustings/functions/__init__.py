"""Column functions: text, numbers, parsing and geometry."""
