"""Spark-native retrieval, lineage and corpus-audit engine."""
