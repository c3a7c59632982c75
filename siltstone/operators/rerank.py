"""Ports for models that score or embed, with deterministic defaults."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[a-z0-9]+")
Scorer = Callable[[str, list[str]], list[float]]


def overlap(query: str, passages: list[str]) -> list[float]:
    """Share of the query's words that a passage holds."""
    asked = set(_WORD.findall(query.lower()))
    return [len(asked & set(_WORD.findall((p or "").lower()))) / len(asked) if asked else 0.0 for p in passages]


def rerank(ranked: DataFrame, scorer: Scorer = overlap, batch: int = 1, deadline_s: float | None = None, query_key: str = "query_id", key: str = "doc_id", query: str = "query", text: str = "text", rank: str = "rank") -> DataFrame:
    """New ranks by the scorer, in micro-batches; what the deadline leaves unscored follows in its old order.

    Equal scores keep their old order. Each query's pool is one row, bounded by its caller.
    """
    result = T.ArrayType(T.DoubleType())

    @F.pandas_udf(result)
    def score(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, passages in rows:
            out = []
            for q, ps in zip(queries, passages, strict=True):
                begun, scores, listed = time.monotonic(), [], list(ps)
                for at in range(0, len(listed), max(1, batch)):
                    if deadline_s is not None and time.monotonic() - begun > deadline_s:
                        break
                    scores += scorer(q or "", listed[at : at + max(1, batch)])
                out.append([*scores, *[None] * (len(listed) - len(scores))])
            yield pd.Series(out)

    pools = ranked.groupBy(query_key, query).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(key).alias("k"), F.col(text).alias("t")))).alias("pool"))
    scored = pools.select(query_key, "pool", score(query, F.transform("pool", lambda p: p["t"])).alias("scores"))
    flat = scored.select(query_key, F.posexplode("pool").alias("at", "p"), "scores").select(query_key, F.col("p.k").alias(key), "at", F.element_at("scores", F.col("at") + 1).alias("score"))
    order = Window.partitionBy(query_key).orderBy(F.desc_nulls_last("score"), F.asc("at"))
    return flat.withColumn(rank, F.row_number().over(order)).drop("at")
