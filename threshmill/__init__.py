"""threshmill: a Spark-native engine for text curation and benchmark analytics."""
