"""Span analytics on Spark: detect, redact, measure and audit sensitive data in text."""

__version__ = "0.1.0"
