"""Palimpsest: Spark-native analytics over durable, redacted, time-aware agent memory."""

__version__ = "0.1.0"
