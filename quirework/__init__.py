"""Spark-native engine for scoring, fusing and repairing the output of text recognizers."""
