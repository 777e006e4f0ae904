"""streaming of shelfwright."""
