"""Zonal statistics and training-data operators on Spark DataFrames."""
