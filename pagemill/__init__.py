"""Spark-native engine for semi-structured records extracted from page text."""
