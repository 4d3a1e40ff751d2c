"""Plans of barloom."""
