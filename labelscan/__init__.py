"""Label inspection analytics on Spark DataFrames."""
