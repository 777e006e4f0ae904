"""operators of shelfwright."""
