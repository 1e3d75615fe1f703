"""Spark-native record linkage and table analytics."""
