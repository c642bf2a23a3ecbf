"""Seismic catalogue analytics on Spark DataFrames."""
