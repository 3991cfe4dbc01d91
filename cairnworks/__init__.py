"""A PySpark-native engine for semi-structured listings and their history."""
