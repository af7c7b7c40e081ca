"""Spark-native analytics for repeated runs of nondeterministic agents."""
