"""Column functions: text, typed values and the wire form."""
