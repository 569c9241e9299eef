"""A Spark-native analytics engine for evidence, retrieval and evaluation data."""
