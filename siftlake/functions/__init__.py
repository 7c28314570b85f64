"""Column functions: built-in expressions only, so that they stay inside generated code."""
