"""Tidemark: Spark-first analytics over large tables of dated, categorised free-text events."""

__version__ = "0.1.0"
