"""tracklake.sources."""
