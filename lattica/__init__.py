"""Lattica: code-and-document knowledge graphs as Spark DataFrames."""
