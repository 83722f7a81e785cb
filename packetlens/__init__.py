"""Spark-native operators for traffic-shift measurement and for the tables behind it."""
