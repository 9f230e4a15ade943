"""Operators for preparing training data, each a function from DataFrames to DataFrames."""
