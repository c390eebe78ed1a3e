"""Utility-network preparation on Spark: scan, detect, validate, merge, match and export."""

__version__ = "0.1.0"
