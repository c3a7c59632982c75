"""Stateful streams: debounce, quiet periods with a cap, stale leases, idempotent inboxes, an outbox relay.

Each function takes a streaming (or batch, where noted) DataFrame and gives one; the caller
chooses sink, trigger and checkpoint. State per key is a few numbers, whatever its history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _seconds(values: pd.Series) -> pd.Series:
    return values.astype("datetime64[us]").astype("int64") / 1e6


def debounce(events: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """Events that come at least ``seconds`` after the last ACCEPTED one of their key; events before it are late and dropped."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        frame = pd.concat(list(batches)).sort_values(at, kind="stable")
        keep = []
        for moment in _seconds(frame[at]):
            taken = last is None or moment - last >= seconds
            keep.append(taken)
            last = moment if taken else last
        state.update((last,))
        yield frame[keep]

    return events.groupBy(key).applyInPandasWithState(step, events.schema, "last double", "append", GroupStateTimeout.NoTimeout)


def quiet_period(events: DataFrame, key: str, at: str, quiet: float, most: float) -> DataFrame:
    """key, first_at, last_at and n of each burst: closed ``quiet`` seconds after its last or ``most`` seconds after its first event.

    Event time drives the decision; the watermark that the caller set on ``at`` closes idle keys.
    """
    schema = f"{key} {events.schema[key].dataType.simpleString()}, first_at timestamp, last_at timestamp, n long"

    def row(name: tuple, first: float, last: float, n: int) -> dict:
        return {key: name[0], "first_at": pd.Timestamp(first, unit="s"), "last_at": pd.Timestamp(last, unit="s"), "n": n}

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            first, last, n = state.get
            out.append(row(name, first, last, n))
            state.remove()
        else:
            first, last, n = state.get if state.exists else (None, None, 0)
            for moment in sorted(_seconds(pd.concat(list(batches))[at])):
                if first is not None and moment >= min(last + quiet, first + most):
                    out.append(row(name, first, last, n))
                    first, n = None, 0
                first = moment if first is None else first
                last, n = moment, n + 1
            state.update((first, last, n))
            due = int(min(last + quiet, first + most) * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "first_at", "last_at", "n"])

    return events.groupBy(key).applyInPandasWithState(step, schema, "first double, last double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def stable_changes(fingerprints: DataFrame, key: str, at: str, fingerprint: str, quiet: float) -> DataFrame:
    """key, fingerprint and kind: a change is passed on once it has stood unchanged for ``quiet`` seconds, a deletion (null fingerprint) at once."""
    schema = f"{key} {fingerprints.schema[key].dataType.simpleString()}, {fingerprint} string, kind string"

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            _, print_ = state.get
            out.append((name[0], print_, "changed"))
            state.remove()
        else:
            since, print_ = state.get if state.exists else (None, None)
            frame = pd.concat(list(batches)).sort_values(at, kind="stable")
            for moment, seen in zip(_seconds(frame[at]), frame[fingerprint], strict=True):
                if print_ is not None and moment - since >= quiet and seen != print_:
                    out.append((name[0], print_, "changed"))
                    print_ = None
                if seen is None or pd.isna(seen):
                    out.append((name[0], None, "deleted"))
                    since, print_ = None, None
                elif seen != print_:
                    since, print_ = moment, seen
            if print_ is None:
                if state.exists:
                    state.remove()
            else:
                state.update((since, print_))
                state.setTimeoutTimestamp(max(int((since + quiet) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, fingerprint, "kind"])

    return fingerprints.groupBy(key).applyInPandasWithState(step, schema, f"since double, {fingerprint} string", "append", GroupStateTimeout.EventTimeTimeout)


def inbox(messages: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """Each message once: repeats that come within ``delay`` of event time are dropped with bounded state."""
    return messages.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def activity(events: DataFrame, at: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts per tumbling window; rows later than ``late`` are left out."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("opened"), *by, "n")


def route(rows: DataFrame, attempts: str, failed: str, most: int) -> DataFrame:
    """ok, retry or dead_letter; a busy peer uses up no attempt, so the caller leaves ``attempts`` unchanged for it."""
    return rows.withColumn("route", F.when(~F.col(failed), "ok").when(F.col(attempts) + 1 >= most, "dead_letter").otherwise("retry"))


def relay(outbox: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, key: str = "id"):
    """Publishes each batch of an outbox stream; the checkpoint makes a batch's number stable, so that a publisher keyed by (batch, key) is idempotent."""
    return outbox.writeStream.foreachBatch(lambda batch, number: publish(batch.dropDuplicates([key]), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
