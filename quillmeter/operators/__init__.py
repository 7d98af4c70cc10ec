"""Operators on DataFrames; columns are named by arguments, so that they run on any table of that shape."""
