"""Spark-first analytics for half-hourly meter readings and their synthetic counterparts."""

__version__ = "0.1.0"
