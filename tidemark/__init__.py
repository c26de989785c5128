"""tidemark: a PySpark-native analytics engine for radar-image time series."""
