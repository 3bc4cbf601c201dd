"""Deterministic document and table intake on Spark DataFrames."""
