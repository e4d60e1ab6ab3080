"""Spark-native analytics over geo-tagged incident, person and recovery tables."""
