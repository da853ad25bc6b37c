"""Column expressions. Nothing here reads data."""
