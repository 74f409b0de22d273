"""Strandel: Spark-native curve and track analytics."""
