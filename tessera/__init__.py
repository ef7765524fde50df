"""A PySpark-native engine for typed, hierarchical, graph-linked records."""
