"""Spark-native timed-text analytics: every operator is a DataFrame -> DataFrame function."""
