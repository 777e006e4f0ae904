"""sources of shelfwright."""
