"""tracklake.operators."""
