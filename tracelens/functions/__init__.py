"""Column functions on text, numbers, times and JSON."""
