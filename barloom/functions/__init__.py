"""Functions of barloom."""
