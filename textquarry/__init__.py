"""A PySpark-native engine for searching and analysing large collections of text."""
