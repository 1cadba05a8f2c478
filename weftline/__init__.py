"""Spark-native checking of documentation against the code it describes, and training-data operators."""
