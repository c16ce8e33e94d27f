"""Planning and the search facade."""
