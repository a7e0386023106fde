"""Typo-tolerant sentence completion on Spark DataFrames."""
