"""Column functions on text and numbers."""
