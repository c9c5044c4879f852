"""Text understanding and data preparation on Spark DataFrames."""
