"""Sluice: a PySpark-native engine for append-only, point-in-time tables about selection processes."""

__version__ = "0.1.0"
