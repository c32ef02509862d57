"""Conversion and de-identification of microscopy images, and data operators, on Spark."""

__version__ = "0.1.0"
