"""Gleaner: a Spark-native evidence-retrieval and corpus-processing engine."""
