"""Event intelligence and corpus work on Spark DataFrames."""
