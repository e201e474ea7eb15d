"""Quire: a PySpark-native engine for document collections."""
