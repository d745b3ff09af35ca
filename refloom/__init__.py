"""A PySpark-native engine that finds, parses and links bibliographic references."""
