"""factorloom: a PySpark-native panel factor engine."""
