"""Tessera: a Spark-native engine for reviewing budget lines and preparing text at scale."""

__version__ = "0.1.0"
