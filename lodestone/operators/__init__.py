"""Operators over entity tables: DataFrames in, DataFrames out."""
