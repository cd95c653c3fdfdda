"""Planar-geometry data quality on PySpark DataFrames."""
