"""Operators over ballots and over dirty data, each a function from DataFrames to DataFrames."""
