"""tracklake: interval-track analytics on Spark DataFrames."""
