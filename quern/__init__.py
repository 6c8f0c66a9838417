"""A Spark-native retrieval and text analytics engine."""
