"""Column functions and value groups."""
