"""Operators over forum tables; each takes and returns DataFrames."""
