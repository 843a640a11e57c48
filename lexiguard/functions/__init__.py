"""Column expressions and scalar text functions."""
