"""Operators on DataFrames: ranking and zone maps."""
