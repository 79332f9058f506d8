"""Operators over entries, queue and messages; pure functions from DataFrames to DataFrames."""
