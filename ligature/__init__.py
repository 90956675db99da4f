"""Spark-native preparation and evaluation of molecule and sequence tables."""
