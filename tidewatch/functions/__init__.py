"""Column expressions, all built-in functions inside code generation."""
