"""All queries of the core library by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import measure_queries, policy_queries, report_queries, search_queries, state_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]


MODULES = (text_queries, search_queries, measure_queries, state_queries, report_queries, policy_queries)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.SQL
    return found
