"""Derived catalogues and the registered queries."""

from .registry import oracle_sql, queries

__all__ = ["queries", "oracle_sql"]
