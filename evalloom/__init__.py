"""A PySpark-native engine for evaluation analytics."""
