"""Bound expressions as Spark columns."""
