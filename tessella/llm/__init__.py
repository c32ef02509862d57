"""Operators for large training-data pipelines, built on Spark."""
