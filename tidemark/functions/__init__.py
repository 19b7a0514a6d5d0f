"""Column functions: built-in expressions only, so plans stay inside generated code."""
