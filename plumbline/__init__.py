"""Exact vector search with typed metadata filters, on Spark DataFrames."""
