"""Trace lineage and corpus preparation on Spark DataFrames."""
