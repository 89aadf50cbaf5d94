"""tidemark: time-series analytics on Spark DataFrames."""
