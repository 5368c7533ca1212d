"""Operators: lazy functions from DataFrames to a DataFrame."""
