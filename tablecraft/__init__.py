"""Spark-native data preparation, modelling, reporting and log analytics."""

__version__ = "0.1.0"
