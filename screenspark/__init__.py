"""Candidate-screening analytics on Spark DataFrames."""
