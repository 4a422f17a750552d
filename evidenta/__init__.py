"""evidenta: a PySpark-native engine for tamper-evident agent decision records."""
