"""Document retrieval, catalogue and evaluation queries on Spark DataFrames."""
