"""Point-in-time disclosure analytics on Spark DataFrames."""
