"""Tessera: source-graph and change-history analytics on Spark DataFrames."""
