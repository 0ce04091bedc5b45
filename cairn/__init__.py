"""Spark-native analytics over time-stamped observations, point sets and the evidence built from them."""
