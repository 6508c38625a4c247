"""tracklake.functions."""
