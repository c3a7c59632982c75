"""Readers for the engine's tables and the rule for redelivered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of parquet tables; a missing column or row is the caller's business, not the reader's."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(frame: DataFrame, key: str | list[str], *newest: Column | str) -> DataFrame:
    """Each key once, as it was delivered last.

    The whole row travels as one struct through a partial aggregate, so a key that was
    delivered very often collapses before the shuffle. Equal rows stay one row; of rows that
    tie in ``newest`` the greatest in the order of the remaining columns is kept, so that the
    result does not depend on partitioning. Rows with a null key count as one key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in frame.columns if c not in keys]
    order = [F.col(c) if isinstance(c, str) else c for c in newest]
    packed = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(f"`{c}`") for c in rest])
    return frame.groupBy(*keys).agg(F.max(packed).alias("_last")).select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in rest])


def schema_with(frame: DataFrame, columns: str | list[str], more: str) -> str:
    """The DDL of some columns of ``frame`` followed by the fields in ``more``."""
    kept = [columns] if isinstance(columns, str) else columns
    return ", ".join([*(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in kept), more])
