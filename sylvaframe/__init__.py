"""Spark-native analytics for 3-D point clouds of trees: every step is a DataFrame in, a DataFrame out."""

__version__ = "0.1.0"
