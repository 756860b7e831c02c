"""Identity-document analytics on Spark DataFrames."""
