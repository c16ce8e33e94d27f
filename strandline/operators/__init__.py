"""Column and table operators of the search."""
