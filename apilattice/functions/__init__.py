"""Column functions over names, signatures, paths and texts."""
