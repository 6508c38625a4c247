"""tracklake.streaming."""
