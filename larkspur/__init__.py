"""A PySpark-native engine for tabular analytics and transaction-risk work."""
