"""Change-review analytics on Spark DataFrames."""
