"""functions of shelfwright."""
