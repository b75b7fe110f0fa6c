"""Tilewright: space-time tiling and analytics of timestamped vector features on PySpark."""

__version__ = "0.1.0"
