"""Column functions: every one returns a Column of built-in expressions."""
