"""Operators on triples and concept graphs, as functions from DataFrames to DataFrames."""
