"""Payment-record analytics on Spark DataFrames."""
