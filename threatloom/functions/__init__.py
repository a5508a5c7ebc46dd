"""Column expressions: pure functions from Column to Column."""
