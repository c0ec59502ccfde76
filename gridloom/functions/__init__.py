"""Column functions and name helpers."""
