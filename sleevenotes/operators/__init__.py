"""Operators over catalog tables: each takes and returns DataFrames."""
