"""Operators that prepare text and activity data for training; nothing else in the library imports this package."""

from siltstone.llm.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
