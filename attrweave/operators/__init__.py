"""Operators over claims, linkage and clusters; each takes and returns DataFrames."""
