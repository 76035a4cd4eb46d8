"""Spark-native analytics for short sequencing reads and large text corpora."""
