"""Batch jobs for product retrieval and its evaluation, as Spark DataFrames."""
