"""Pathloom: code-path analytics on Spark DataFrames."""
