"""Spark-native operators that turn raw corpora into training and retrieval datasets."""
