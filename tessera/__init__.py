"""A PySpark-native engine for scoped text memories and training-data pipelines."""
