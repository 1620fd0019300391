"""Spark-native processing of large batches of model calls: privacy, scoring, attempts, cost, drift, state."""
