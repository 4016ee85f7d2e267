"""A PySpark-native document, graph and vector analytics engine."""
