"""Operators for training data. Nothing outside this package imports it."""

from curbside.llm.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
