"""Scored-text analytics on Spark DataFrames."""
