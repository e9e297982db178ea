"""Operators on DataFrames: encoding, search, keyed changes, metrics."""
