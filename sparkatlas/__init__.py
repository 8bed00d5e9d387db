"""Spark-native knowledge retrieval, graph and log analytics."""
