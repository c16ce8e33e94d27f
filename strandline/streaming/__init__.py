"""Stream-static search."""
