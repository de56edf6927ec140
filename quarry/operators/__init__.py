"""Bound queries as DataFrames."""
