"""All queries of the subpackage by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import disclosure, foreign_code, leakage, percentiles, quoted_mail, scanned_pages, spam_pages, splitting, tokenizing

MODULES = (scanned_pages, splitting, percentiles, tokenizing, leakage, spam_pages, quoted_mail, disclosure, foreign_code)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.SQL
    return found
