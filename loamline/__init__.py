"""Spark-native analytics over source repositories held as DataFrames."""
