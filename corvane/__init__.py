"""corvane: a PySpark-native file-index analytics engine."""
