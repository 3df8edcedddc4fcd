"""Gradient-boosted tree analytics on Spark DataFrames."""
