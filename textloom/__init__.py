"""A PySpark-native engine that turns raw documents into instruction and training data."""
