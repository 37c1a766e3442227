"""Groundline: a PySpark-native engine for citation-grounded document analytics."""
