"""A PySpark-native engine for static-retrieval data preparation and analytics."""
