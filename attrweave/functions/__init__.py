"""Column functions: strings, tokens and numbers."""
