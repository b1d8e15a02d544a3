"""Lectern: a Spark-first engine that turns document text and layout into narration-ready text."""

__version__ = "0.1.0"
