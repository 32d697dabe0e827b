"""Column functions: levels, guards, text."""
