"""decisium: a Spark-native engine for multiple-choice decision corpora."""
