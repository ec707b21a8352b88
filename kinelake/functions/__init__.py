"""Column functions: geometry, text, arrays."""
