"""A Spark-native engine for panel text analytics."""
