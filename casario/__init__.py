"""A Spark-native analytics library for property listings."""
