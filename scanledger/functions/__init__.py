"""Column expressions; all built-in, so they stay in generated code."""
