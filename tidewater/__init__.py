"""Spark-native cleansing of dirty operational tables, and operators for training-data corpora."""
