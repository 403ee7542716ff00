"""Column and array functions."""
