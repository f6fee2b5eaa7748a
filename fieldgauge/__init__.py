"""Spark-native profiling, cleaning, coverage measurement and evidence
resolution for large entity tables. Every operator takes and returns
DataFrames; nothing runs until the caller acts on the result."""

__version__ = "0.1.0"
