"""Operators over documents: each takes DataFrames and returns a DataFrame."""
