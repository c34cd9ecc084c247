"""Retrieval, graph and memory analytics on Spark DataFrames."""
