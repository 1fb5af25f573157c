"""Analytics over text evidence and evaluation records, on Spark DataFrames."""
