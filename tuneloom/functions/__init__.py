"""Column functions: text, tokens and arrays."""
