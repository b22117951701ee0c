"""Positional co-occurrence analytics on Spark DataFrames."""
