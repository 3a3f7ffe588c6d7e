"""Operators a training-data pipeline needs, each a function from DataFrames to
DataFrames. Nothing else in the package imports this subpackage."""
