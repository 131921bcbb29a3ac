"""Sievework: evidence retrieval, ranking and reporting, and training-data preparation, on Spark DataFrames."""
