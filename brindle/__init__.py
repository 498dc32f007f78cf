"""brindle: a PySpark-native engine for structured log journals."""
