"""knotweave: a PySpark-native analytics engine for dependency graphs."""
