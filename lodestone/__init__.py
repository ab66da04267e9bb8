"""Lodestone: hybrid code and text retrieval on Spark DataFrames."""
