"""Spark-native document-corpus engine: every operator takes and returns DataFrames."""
