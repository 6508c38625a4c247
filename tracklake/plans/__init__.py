"""tracklake.plans."""
