"""A PySpark-native engine for source-grounded document analytics."""
