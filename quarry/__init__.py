"""Quarry: strictly validated analytics over Parquet, planned and run by Spark."""

__version__ = "0.1.0"
