"""Ordered lists, listening history and record matching on Spark DataFrames."""
