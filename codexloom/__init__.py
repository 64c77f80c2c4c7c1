"""A PySpark-native engine for corpora of long documents."""
