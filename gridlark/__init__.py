"""A PySpark-native engine for exploring and analysing large tables, and for building text corpora."""
