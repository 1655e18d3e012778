"""Language-resource analytics on Spark DataFrames."""
