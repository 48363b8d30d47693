"""Block-oriented batch analytics on Spark DataFrames."""
