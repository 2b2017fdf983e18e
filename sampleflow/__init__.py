"""Ordered, resumable sample pipelines for language-model data on Spark."""

__version__ = "0.1.0"
