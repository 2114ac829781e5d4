"""PySpark-native detection of anomalous API traffic."""
