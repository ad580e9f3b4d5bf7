"""Column functions; none runs Python per row."""
