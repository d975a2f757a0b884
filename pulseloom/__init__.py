"""Spark-native trend and burst analytics over social event data."""

__version__ = "0.1.0"
