"""A Spark-native engine that prepares and evaluates speech-and-text sequence data."""
