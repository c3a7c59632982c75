"""Aggregates over events and runs: percentiles, facets, roll-ups, deltas, retrieval measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import cut_lineage


def facets(frame: DataFrame, filters: Mapping[str, Sequence[str]]) -> DataFrame:
    """facet, value and n: for each facet the values that remain under all OTHER filters, in one pass over the rows."""
    entries = []
    for name in filters:
        others = F.lit(True)
        for other, chosen in filters.items():
            if other != name and chosen:
                others = others & F.coalesce(F.col(other).isin(list(chosen)), F.lit(False))
        entries.append(F.when(others, F.struct(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value"))))
    rows = frame.select(F.explode(F.array_compact(F.array(*entries))).alias("x")).select("x.*")
    return rows.where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def top_rows(frame: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their position."""
    window = Window.partitionBy(*by).orderBy(*order)
    return frame.withColumn("position", F.row_number().over(window)).where(F.col("position") <= k)


def branch_counts(root: DataFrame, key: str, branches: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Counts of several child tables per root: each child is aggregated before it is joined, so that counts do not multiply."""
    for name, (child, parent) in branches.items():
        counted = child.groupBy(F.col(parent).alias(key)).agg(F.count(F.lit(1)).alias(name))
        root = root.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return root


def with_previous(frame: DataFrame, by: Sequence[str], order: Sequence[Column], metrics: Sequence[str]) -> DataFrame:
    """Each run with the difference of its metrics to the run before of the same group, null for the first."""
    window = Window.partitionBy(*by).orderBy(*order)
    return frame.select("*", *[(F.col(m) - F.lag(m).over(window)).alias(f"{m}_delta") for m in metrics])


def retrieval_measures(observed: Column, expected: Column) -> dict[str, Column]:
    """Per case: top1, hit_at_3, recall_at_5, mrr and ndcg_at_5 of the first relevant result, from arrays of ids."""
    hits = F.filter(F.transform(expected, lambda e: F.array_position(observed, e).cast("int")), lambda p: p > 0)
    first = F.array_min(hits)
    found5 = F.size(F.array_intersect(F.slice(observed, 1, 5), expected))
    return {
        "top1": F.coalesce((first == 1).cast("double"), F.lit(0.0)),
        "hit_at_3": F.coalesce((first <= 3).cast("double"), F.lit(0.0)),
        "recall_at_5": F.when(F.size(expected) > 0, found5 / F.size(expected)).otherwise(0.0),
        "mrr": F.coalesce(F.lit(1.0) / first, F.lit(0.0)),
        "ndcg_at_5": F.coalesce(F.when(first <= 5, F.lit(1.0) / F.log2(first + F.lit(1.0))), F.lit(0.0)),
    }


def threshold_sweep(pairs: DataFrame, similarity: str, truth: str, thresholds: Sequence[float]) -> DataFrame:
    """False positives, false negatives and passes per threshold, in one pass over the pairs."""
    steps = F.array(*[F.lit(float(t)) for t in thresholds])
    said = F.col(similarity) >= F.col("threshold")
    rows = pairs.select(similarity, truth, F.explode(steps).alias("threshold"))
    return rows.groupBy("threshold").agg(F.count_if(said & ~F.col(truth)).alias("false_positives"), F.count_if(~said & F.col(truth)).alias("false_negatives"), F.count_if(said == F.col(truth)).alias("passes"))


def rank_measures(first: Column, found: Column, relevant: Column) -> dict[str, Column]:
    """The measures of ``retrieval_measures`` from the first relevant rank (null for none), the relevant among the best five, and all relevant."""
    return {
        "top1": F.coalesce((first == 1).cast("double"), F.lit(0.0)),
        "hit_at_3": F.coalesce((first <= 3).cast("double"), F.lit(0.0)),
        "recall_at_5": F.coalesce(found / F.nullif(relevant, F.lit(0)), F.lit(0.0)),
        "mrr": F.coalesce(F.lit(1.0) / first, F.lit(0.0)),
        "ndcg_at_5": F.coalesce(F.when(first <= 5, F.lit(1.0) / F.log2(first + F.lit(1.0))), F.lit(0.0)),
    }


def sweep_from(close: DataFrame, similarity: str, truth: str, totals: tuple[int, int], thresholds: Sequence[float]) -> DataFrame:
    """The columns of ``threshold_sweep`` from the pairs at or above the least threshold and the (true, false) totals of all pairs.

    Pairs below the least threshold are told by the totals, so they need not be made.
    """
    steps = F.array(*[F.struct(F.lit(float(t)).alias("threshold")) for t in thresholds])
    rows = close.select(similarity, truth, F.inline(steps)).where(F.col(similarity) >= F.col("threshold"))
    said = rows.groupBy("threshold").agg(F.count_if(truth).alias("t"), F.count_if(~F.col(truth)).alias("f"))
    every = close.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double").join(F.broadcast(said), "threshold", "left").na.fill(0)
    true, false = (F.lit(n) for n in totals)
    return every.select("threshold", F.col("f").alias("false_positives"), (true - F.col("t")).alias("false_negatives"), (F.col("t") + false - F.col("f")).alias("passes"))


def running_total(frame: DataFrame, order: Sequence[Column | str], value: str, name: str = "before") -> DataFrame:
    """Each row with the sum of ``value`` over all rows before it in a total order, without gathering them in one task.

    Rows are range-partitioned; each partition sums its own, and one row per partition tells
    what lies before it. Nulls count as 0.
    """
    placed = cut_lineage(frame.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    whole = placed.groupBy("_p").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_s"))  # one row a partition
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select("_p", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_o"))
    own = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("_p", "_o")
