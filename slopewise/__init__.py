"""Street-network climb analytics on Spark DataFrames."""
