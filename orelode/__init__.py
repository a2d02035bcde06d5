"""Spark-native code and text evidence analytics."""
