"""A PySpark-native engine that reconciles two sides of transactions and explains every result."""
