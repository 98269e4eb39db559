"""Column expressions and the fixed values they use."""
