"""Spark-first building blocks of the engine."""
