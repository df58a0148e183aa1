"""Column expressions shared by the operators (no Python in the row path)."""
