"""File inventory and content identity on Spark DataFrames."""
