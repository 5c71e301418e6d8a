"""Spark-native tabular data audit: profiling, quality, tests and modelling."""

__version__ = "0.1.0"
