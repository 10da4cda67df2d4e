"""Lodestar: multimodal analytics on Spark DataFrames."""
