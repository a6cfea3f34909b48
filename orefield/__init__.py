"""Spark-native analytics over source-backed evidence: index, relate, retrieve, audit."""

__version__ = "0.1.0"
