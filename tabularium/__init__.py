"""Spark-first engine that carries a raw table to an interpretable prediction."""

__version__ = "0.1.0"
