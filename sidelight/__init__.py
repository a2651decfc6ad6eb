"""A Spark-native engine for describing, indexing and searching media archives."""
