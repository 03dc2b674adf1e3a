"""Catalogue data-quality, resolution, splitting and evaluation on Spark DataFrames."""
