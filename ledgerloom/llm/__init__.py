"""Corpus preparation operators for training data, each a function from DataFrames to a DataFrame."""
