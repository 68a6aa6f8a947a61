"""Bi-temporal entity-graph analytics on Spark DataFrames."""
