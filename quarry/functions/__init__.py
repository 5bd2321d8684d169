"""Column functions: text, structure, lexical analysis."""
