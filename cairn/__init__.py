"""Cairn: a Spark-native analytics engine for versioned, deduplicating storage."""
