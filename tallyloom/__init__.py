"""Commit-history analytics as PySpark DataFrame transforms."""

__version__ = "0.2.0"
