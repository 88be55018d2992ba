"""fluxloom: a PySpark-native engine for online learning and stream analytics."""

__version__ = "0.1.0"
