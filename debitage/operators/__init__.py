"""Operators on mesh tables: DataFrames in, DataFrames out."""
