"""Spatial analytics on PySpark: geometry columns, spatial queries, layouts and joins."""

__version__ = "0.1.0"
