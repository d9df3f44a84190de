"""Vector and metadata search on Spark DataFrames."""
