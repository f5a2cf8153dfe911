"""Catalog reconciliation and record linkage on Spark DataFrames."""
