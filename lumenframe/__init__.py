"""Manifest, clip and preference analytics on Spark DataFrames."""
