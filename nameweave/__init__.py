"""Spark-native entity resolution: every operator maps DataFrames or Columns to DataFrames or Columns."""
