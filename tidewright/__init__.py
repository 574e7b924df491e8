"""A Spark-native analytics engine for vector- and graph-based recommendation."""
