"""Spindrift: a PySpark-native analytics engine for batch OLAP over CSV and Parquet."""

__version__ = "0.1.0"
