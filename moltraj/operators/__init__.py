"""Operators over trajectory tables; each takes and returns DataFrames."""
