"""Spark-first analytics over document collections."""
