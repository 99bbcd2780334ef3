"""Scholarly-record integration and retrieval analytics on Spark DataFrames."""
