"""Codexmill: Spark-native auditing, profiling and derivation over snapshots of legal text."""

__version__ = "0.1.0"
