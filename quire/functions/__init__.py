"""Column functions over text, vectors and money."""
