"""A PySpark-native engine for retrieval and graph questions over documents."""
