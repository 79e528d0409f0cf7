"""A PySpark-native keyspace analytics engine."""
