"""Physical helpers: row numbers, boundaries, indexes and zone maps."""
