"""Exact percentiles per group of very large numeric columns (problem 5).

Partial results are counts per (group, value): they are exact, can be kept per day or per
partition and merged by adding up. The percentiles come from one distributed sort of the
merged counts: the sorted partitions are counted per group, the counts become offsets of the
partitions within their group, and every wanted rank is looked up in the one partition that
holds it. The error bound is therefore 0 (ranks and neighbours are exact, no sketch is used).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.session import cut_lineage
from siltstone.tables import table

PERCENTS = (50, 90, 99)
LEAST_ROWS = 60
BLANKS = r"(?U)^\s+|\s+$"


def activity_once(events: DataFrame) -> DataFrame:
    """service (trimmed, lower case), activity_class, duration_ms and day of every event id that has a duration.

    Redelivered rows of an id are equal; should they differ, the greatest row wins. Rows without
    an id are one event each. Rows whose duration is null are left out; a null service or class
    is a group of its own.
    """
    row = F.struct(
        F.col("duration_ms").cast("long").alias("value"),
        F.lower(F.regexp_replace("service", BLANKS, "")).alias("service"),
        "activity_class",
        F.to_date("started_at").alias("day"),
    )
    timed = events.where(F.col("duration_ms").isNotNull())
    known = timed.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(row).alias("r"))
    return known.select("r.*").unionByName(timed.where(F.col("id").isNull()).select(row.alias("r")).select("r.*"))


def value_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A partial result: how often each value occurs for each combination of ``keys``."""
    return rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial results of several days or partitions as one; further columns such as a day are summed away."""
    wanted = [p.select(*keys, "value", "n") for p in partials]
    merged = wanted[0]
    for part in wanted[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def percentiles_of_counts(counts: DataFrame, keys: Sequence[str], percents: Sequence[int] = PERCENTS, least_rows: int = 1) -> DataFrame:
    """keys, pct, n, nearest (the value at rank ceil(pct/100*n)) and interpolated (linear between neighbours).

    Groups with fewer than ``least_rows`` values are left out, an empty input gives no rows, and
    a group with one distinct value gives that value for each percent. No group is ever held by
    one task: a hot group is spread over as many sorted partitions as it fills, and what is
    gathered per group is one row per partition.
    """
    keys = list(keys)
    ordered = counts.repartitionByRange(*keys, "value").sortWithinPartitions(*keys, "value").withColumn("part", F.spark_partition_id())
    ordered = cut_lineage(ordered)  # the ranges are sampled; both readers below must see the same ones
    per_part = ordered.groupBy(*keys, "part").agg(F.sum("n").alias("in_part"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *keys, "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"), F.sum("in_part").over(group).alias("total")
    ).where(F.col("total") >= least_rows)
    inside = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ordered.withColumn("running", F.sum("n").over(inside)).alias("a")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "part"]]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    located = ranked.join(offsets.alias("b"), condition).select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        F.col("a.value").alias("value"),
        F.col("b.total").alias("n"),
        (F.col("b.offset") + F.col("a.running") - F.col("a.n")).alias("below"),
        (F.col("b.offset") + F.col("a.running")).alias("upto"),
    )
    targets = F.array(
        *[
            F.struct(
                F.lit(int(p)).alias("pct"),
                F.greatest(F.lit(1).cast("long"), F.expr(f"(n * {int(p)} + 99) div 100")).alias("rank"),
                F.expr(f"((n - 1) * {int(p)}) div 100 + 1").alias("low"),
                F.expr(f"((n - 1) * {int(p)}) % 100 / 100.0D").alias("part"),
            )
            for p in percents
        ]
    )
    hits = located.select(*keys, "value", "n", "below", "upto", F.explode(targets).alias("t"))
    holds = lambda rank: (F.col("below") < rank) & (F.col("upto") >= rank)
    low, high = F.col("t.low"), F.least(F.col("t.low") + 1, F.col("n"))
    hits = hits.where(holds(F.col("t.rank")) | holds(low) | holds(high))
    found = hits.groupBy(*keys, F.col("t.pct").alias("pct")).agg(
        F.max("n").alias("n"),
        F.max(F.when(holds(F.col("t.rank")), F.col("value"))).alias("nearest"),
        F.max(F.when(holds(low), F.col("value"))).alias("v_low"),
        F.max(F.when(holds(high), F.col("value"))).alias("v_high"),
        F.max("t.part").alias("part"),
    )
    return found.select(*keys, "pct", "n", "nearest", (F.col("v_low") + (F.col("v_high") - F.col("v_low")) * F.col("part")).alias("interpolated"))


KEYS = ("service", "activity_class")


def duration_percentiles(spark: SparkSession, folder: str, least_rows: int = 1) -> DataFrame:
    counts = value_counts(activity_once(table(spark, folder, "model_activity_events")), KEYS)
    return percentiles_of_counts(counts, KEYS, PERCENTS, least_rows)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Bands of the exact percentiles; a percentile of 0 or less, which has no logarithm, is band -1."""
    found = duration_percentiles(spark, folder, LEAST_ROWS)
    band = F.when(F.col("nearest") >= 1, F.length(F.conv(F.col("nearest").cast("string"), 10, 2)) - 1).otherwise(-1)
    return found.select(*KEYS, "pct", band.cast("int").alias("band"))


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Every group with its exact percentiles; the stated error bound is 0."""
    found = duration_percentiles(spark, folder)
    return found.select(*KEYS, "pct", "n", "nearest", F.round("interpolated", 6).alias("interpolated"), F.lit(0).alias("error_bound"))


_ONCE = """
WITH once AS (
  SELECT id, max(duration_ms) AS value, max(lower(regexp_replace(service, '^\\s+|\\s+$', '', 'g'))) AS service, max(activity_class) AS activity_class
  FROM model_activity_events WHERE duration_ms IS NOT NULL GROUP BY id
), ranked AS (
  SELECT service, activity_class, value,
         row_number() OVER (PARTITION BY service, activity_class ORDER BY value) AS rk,
         count(*) OVER (PARTITION BY service, activity_class) AS n
  FROM once
), p AS (SELECT unnest([50, 90, 99]) AS pct)
"""

QUERIES = {"p5_found": p5_found, "p5_percentiles": p5_percentiles}
SQL = {
    "p5_found": _ONCE
    + """
SELECT service, activity_class, CAST(pct AS INTEGER) AS pct, CAST(floor(log2(value)) AS INTEGER) AS band
FROM ranked, p WHERE n >= 60 AND rk = (n * pct + 99) // 100
""",
    "p5_percentiles": _ONCE
    + """
SELECT service, activity_class, CAST(pct AS INTEGER) AS pct, n,
       CAST(max(CASE WHEN rk = greatest(1, (n * pct + 99) // 100) THEN value END) AS BIGINT) AS nearest,
       round(max(CASE WHEN rk = ((n - 1) * pct) // 100 + 1 THEN value END)
         + (max(CASE WHEN rk = least(((n - 1) * pct) // 100 + 2, n) THEN value END) - max(CASE WHEN rk = ((n - 1) * pct) // 100 + 1 THEN value END))
           * (((n - 1) * pct) % 100 / 100.0), 6) AS interpolated,
       0 AS error_bound
FROM ranked, p GROUP BY service, activity_class, pct, n
""",
}
