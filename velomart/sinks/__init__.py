"""Table writes."""
