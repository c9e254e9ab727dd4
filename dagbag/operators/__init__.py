"""Histories and their algebra."""

from dagbag.operators.history import COLLAPSE, LINEAR, MEMOIZATION, History

__all__ = ["COLLAPSE", "LINEAR", "MEMOIZATION", "History"]
