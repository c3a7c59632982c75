"""Selection from queues and states derived from event logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim(pending: DataFrame, running: DataFrame, family: str, key: str, priority: str, created: str, cap: int, limit: int) -> DataFrame:
    """The next jobs: of each family as many as its cap leaves beside those running, then by priority, age and key."""
    busy = running.groupBy(family).agg(F.count(F.lit(1)).alias("_busy"))
    order = [F.desc(priority), F.asc(created), F.asc(key)]
    ranked = pending.withColumn("_n", F.row_number().over(Window.partitionBy(family).orderBy(*order))).where(F.col("_n") <= cap)
    allowed = ranked.join(busy, family, "left").where(F.col("_n") <= F.greatest(F.lit(0), F.lit(cap) - F.coalesce("_busy", F.lit(0))))
    return allowed.orderBy(*order).limit(limit).drop("_n", "_busy")


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """A keyed merge: each key once, the row of the highest version; changes win over equal current versions."""
    both = current.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    rest = [c for c in both.columns if c not in (*keys, version, "_side")]
    merged = both.groupBy(*keys).agg(F.max(F.struct(version, "_side", *rest)).alias("r"))
    return merged.select(*keys, f"r.{version}", *[f"r.{c}" for c in rest])


def accepted(events: DataFrame, by: Sequence[str], at: Column, key: str, quiet: int) -> DataFrame:
    """Debounce: an event is taken unless one of its key was taken less than ``quiet`` seconds before.

    An event at least ``quiet`` after the one before it is taken whatever was taken earlier, so a
    key falls into runs that do not depend on each other; runs are spread over the tasks and
    pass them in order, with the last time taken as the only state. Events without a time are
    never taken; equal times are settled by ``key``.
    """
    timed = events.select(*by, at.cast("long").alias("_t"), key).where("_t IS NOT NULL")
    order = Window.partitionBy(*by).orderBy("_t", key)
    fresh = F.coalesce(F.col("_t") - F.lag("_t").over(order) >= quiet, F.lit(True))
    runs = timed.withColumn("_r", F.sum(fresh.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    schema = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in (*by, key))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last = None, 0
        for batch in batches:
            kept = []
            for i, (*name, t) in enumerate(zip(*(batch[c] for c in (*by, "_r", "_t")), strict=True)):
                if name != group or t - last >= quiet:
                    group, last = name, t
                    kept.append(i)
            yield batch.iloc[kept][[*by, key]]

    return runs.repartition(*by, "_r").sortWithinPartitions(*by, "_r", "_t", key).mapInPandas(take, schema)


def revisions(events: DataFrame, by: Sequence[str], order: Sequence[Column], content: Column) -> DataFrame:
    """event (added, updated or unchanged) and revision number of each observation of a source."""
    window = Window.partitionBy(*by).orderBy(*order)
    before = F.lag("_c").over(window)
    marked = events.withColumn("_c", content).withColumn("event", F.when(F.row_number().over(window) == 1, "added").when(~before.eqNullSafe(F.col("_c")), "updated").otherwise("unchanged"))
    return marked.withColumn("revision", F.sum((F.col("event") != "unchanged").cast("long")).over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def head_batch(queue: DataFrame, lane: str, order: Sequence[Column], same: Column, size: Column, most: int, most_bytes: int) -> DataFrame:
    """The batch at the head of the queue: the lowest lane with work, in order, as long as the items are alike and the caps hold."""
    lowest = queue.agg(F.min(lane).alias("_lane"))
    first = queue.join(F.broadcast(lowest), F.col(lane) == F.col("_lane")).orderBy(*order).limit(most)
    window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # at most ``most`` rows
    head = F.first(same).over(window)
    counted = first.withColumn("_odd", F.sum((~same.eqNullSafe(head)).cast("int")).over(window)).withColumn("_bytes", F.sum(size).over(window))
    return counted.where((F.col("_odd") == 0) & (F.col("_bytes") <= most_bytes)).drop("_odd", "_bytes", "_lane")


def bounded(arrivals: DataFrame, by: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """Each arrival with ``taken``: whether the queue of its group, which holds ``size``, still had room."""
    return arrivals.withColumn("taken", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= size)


def due(schedules: DataFrame, last: Column, now: Column, interval: int) -> DataFrame:
    """The schedules whose last run lies ``interval`` seconds back, with the number of runs missed besides the one now due.

    A schedule that never ran is due with nothing missed.
    """
    late = now - last
    return schedules.where(late.isNull() | (late >= interval)).withColumn("missed", F.coalesce(F.floor(late / interval).cast("long") - 1, F.lit(0)))
