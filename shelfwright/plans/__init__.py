"""plans of shelfwright."""
