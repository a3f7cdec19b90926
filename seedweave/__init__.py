"""Sequence classification as Spark DataFrame operations."""
