"""weftline: a PySpark-native engine for web-scale text analytics."""
