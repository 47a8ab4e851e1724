"""folioforge: a Spark-native analytics engine for document corpora."""
