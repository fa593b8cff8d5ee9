"""Vocabulary analytics on Spark: text in, word lists out."""

__version__ = "0.1.0"
