"""Spark-native analytics over social event logs."""
