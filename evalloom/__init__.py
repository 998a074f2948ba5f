"""Batch analytics over labelled-text evaluation data, as composable Spark jobs."""

__version__ = "0.1.0"
