"""Catalogue enrichment and training-data preparation on Spark DataFrames."""
