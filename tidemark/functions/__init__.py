"""Column and window functions over ordered series."""
