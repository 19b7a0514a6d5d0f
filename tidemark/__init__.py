"""Period-aware panel analytics on Spark DataFrames."""
