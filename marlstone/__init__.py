"""Spark-native analytics for ordered series, order books and corpora."""
