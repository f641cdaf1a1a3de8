"""Spark-native snapshot, graph and corpus analytics."""
