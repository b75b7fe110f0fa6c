"""Operators on feature DataFrames."""
