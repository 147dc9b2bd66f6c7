"""Opinion analytics on Spark DataFrames."""
