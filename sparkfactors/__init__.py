"""Spatial factor analytics on Spark: counts, graphs, factor models, domains and their metrics as DataFrames."""
