"""Stateless operators on streaming DataFrames."""
