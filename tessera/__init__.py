"""A PySpark-native engine that prepares, scores and analyses language-to-graph-query experiments."""
