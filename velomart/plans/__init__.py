"""Warehouse models and analytical queries, each a function from DataFrames to a DataFrame."""
