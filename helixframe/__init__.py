"""Spark-native analytics for sequencing reads, with batch operators for text corpora beside it."""
