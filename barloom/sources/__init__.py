"""Sources of barloom."""
