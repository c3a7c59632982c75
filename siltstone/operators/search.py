"""Lexical and vector ranking, fusion, filtering, collapsing and packing of results.

All operators take and give DataFrames. Rankings are (query_id, doc_id, score); ties are broken
by the document's key everywhere, so that results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.session import cut_lineage

K1, B = 1.2, 0.75
RRF_K = 60
#: Sides below this many bytes are sent to every executor; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Trigram search: pairs of a name and a query for one task, names in one task, and pairs that wait until the best of each query are kept.
PIECE_PAIRS, PIECE_ROWS, WAITING_PAIRS = 1 << 30, 500_000, 1_000_000


def small(frame: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``frame`` marked for broadcast if its text, counted first, stays below the limit; unchanged otherwise."""
    size = frame.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    return F.broadcast(frame) if size <= limit else frame


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key and tf: one row per distinct term of a document. Null and wordless texts have none."""
    terms = docs.where(F.col(text).isNotNull()).select(key, F.explode(X.ascii_tokens(text)).alias("term"))
    return terms.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "query_id", query: str = "query") -> DataFrame:
    """query_key, key and score of every document that shares a term with a query.

    Documents are read once for their lengths and once for the postings of the queries' terms;
    only these postings are shuffled.
    """
    # the tokens are a step of their own: beside an explode they would be computed once per token
    present = docs.where(F.col(text).isNotNull()).select(key, X.ascii_tokens(text).alias("_ts")).select(key, "_ts", F.size("_ts").alias("dl"))
    stats = present.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    wanted = queries.select(query_key, F.explode(F.array_distinct(X.ascii_tokens(query))).alias("term"))
    terms = small(wanted.select("term").distinct())
    tokens = present.select(key, "dl", F.explode("_ts").alias("term"))
    postings = tokens.join(terms, "term", "left_semi").groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))
    postings = cut_lineage(postings)
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(stats["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    avgdl = float(stats["avgdl"] or 1.0)
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    weighed = postings.join(df.select("term", idf.alias("idf")), "term").select("term", key, weight.alias("w"))
    return weighed.join(small(wanted), "term").groupBy(query_key, key).agg(F.sum("w").alias("score"))


def top_k(scores: DataFrame, k: int, query_key: str = "query_id", key: str = "doc_id", score: str = "score") -> DataFrame:
    """The best ``k`` of each query with their rank; the limit is pushed below the shuffle."""
    order = Window.partitionBy(query_key).orderBy(F.desc(score), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", block_rows: int = 2000) -> DataFrame:
    """Exact cosine neighbours of a stated query set, searched in blocks of bounded size; each vector block keeps its own best ``k`` before the shuffle.

    Vectors without length or of another dimension have no neighbours.
    """
    count = queries.count()
    blocks = max(1, -(-count // block_rows))
    found = None
    for number in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == number)
        rows = [(r[0], r[1]) for r in part.select(query_key, vector).where(F.col(vector).isNotNull()).collect()]  # at most a block
        one = _nearest(vectors, rows, k, key, vector, query_key, queries.schema[query_key].dataType.simpleString())
        found = one if found is None else found.unionByName(one)
    return top_k(found, k, query_key, key)


def _nearest(vectors: DataFrame, rows: list[tuple], k: int, key: str, vector: str, query_key: str, key_type: str) -> DataFrame:
    """The best ``k`` of every batch of vectors for each query, by one matrix product per batch and dimension."""
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for size in {len(v) for _, v in rows}:
        chosen = [(q, v) for q, v in rows if len(v) == size and any(v)]
        if chosen:
            m = np.array([v for _, v in chosen], dtype=np.float64)
            by_size[size] = ([q for q, _ in chosen], m / np.linalg.norm(m, axis=1, keepdims=True))
    shared = vectors.sparkSession.sparkContext.broadcast(by_size)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch[vector].map(lambda v: -1 if v is None else len(v))
            for size, (names, unit) in shared.value.items():
                mine = batch[lengths == size]
                if not len(mine):
                    continue
                m = np.stack(mine[vector].to_numpy()).astype(np.float64)
                norms = np.linalg.norm(m, axis=1)
                keys, m = mine[key].to_numpy()[norms > 0], m[norms > 0] / norms[norms > 0][:, None]
                if not len(keys):
                    continue
                close = m @ unit.T
                # the k-th best score of each query; everything that ties with it is kept
                cut = np.partition(close, len(keys) - k, axis=0)[len(keys) - k] if len(keys) > k else np.full(len(names), -np.inf)
                at, which = np.nonzero(close >= cut)
                yield pd.DataFrame({query_key: [names[j] for j in which], key: keys[at], "score": close[at, which]})

    return vectors.select(key, vector).mapInPandas(search, f"{query_key} {key_type}, {key} {vectors.schema[key].dataType.simpleString()}, score double")


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    """Shared trigrams over all trigrams of two short texts; 0 where neither has any."""
    ta, tb = X.trigrams(a), X.trigrams(b)
    shared = F.size(F.array_intersect(ta, tb))
    return F.coalesce(shared / F.nullif(F.size(ta) + F.size(tb) - shared, F.lit(0)), F.lit(0.0))


def trigram_search(names: DataFrame, queries: DataFrame, key: str, name: str, query_key: str, query: str, threshold: float, k: int, digits: int = 6, block_rows: int = 20_000) -> DataFrame:
    """query_key, key, score and rank of the best ``k`` names of each query that reach the threshold, by the rounded score, then the key.

    A text's trigrams are those of its distinct words, so names of the same words are scored once,
    and only the ``k`` least keys among them can be among the best. Queries of the same words are
    asked once, in blocks of bounded size; each piece of the names keeps its own best ``k`` before
    the shuffle. Rows count as they come: a repeated one is ranked twice.
    """

    def words(c: str) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(X.ascii_tokens(c))), " ")

    def best(frame: DataFrame, by: str, *order: Column) -> DataFrame:
        return frame.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)

    # names without words go afterwards: the condition would move below the window and take every name apart a second time
    members = cut_lineage(best(names.select(key, words(name).alias("_words")), "_words", F.asc_nulls_last(key))).where("_words <> ''")
    groups = members.where("rank = 1").select("_words", F.col(key).alias("_least"))
    asked = queries.select(query_key, words(query).alias("_asked")).where("_asked <> ''")
    texts = cut_lineage(asked.select("_asked").distinct())
    count, rows = texts.count(), groups.count()
    blocks = max(1, -(-count // block_rows))
    # an exchange that is asked for by number is not made smaller again: the work lies in the pairs, not in the bytes
    pieces = groups.repartition(max(rows * min(count, block_rows) // PIECE_PAIRS, rows // PIECE_ROWS) + 1, "_words").sortWithinPartitions(F.asc_nulls_last("_least"))
    found = None
    for number in range(blocks):
        part = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("_asked"), F.lit(blocks)) == number)
        one = _alike(pieces, [r[0] for r in part.collect()], threshold, k, digits)  # at most about a block
        found = one if found is None else found.unionByName(one)
    # k groups before a group have k keys before its keys
    first = best(found, "_asked", F.desc("score"), F.asc_nulls_last("_least")).select("_asked", "_words", "score")
    nearest = best(members.drop("rank").join(first, "_words"), "_asked", F.desc("score"), F.asc_nulls_last(key))
    nearest = cut_lineage(nearest.select("_asked", key, "score"))
    return best(asked.join(small(nearest), "_asked").select(query_key, key, "score"), query_key, F.desc("score"), F.asc_nulls_last(key))


def _trigrams(words: str) -> set[str]:
    """As ``text.trigrams``, of lower-case words with a blank between them."""
    return {f"  {w} "[i : i + 3] for w in words.split(" ") for i in range(len(w) + 1)}


def _alike(groups: DataFrame, texts: list[str], threshold: float, k: int, digits: int) -> DataFrame:
    """The best ``k`` groups of every partition for each text, by counts over the texts' inverted index; partitions come sorted, so that of equal scores the first are the best."""
    lists: dict[str, list[int]] = {}
    for i, text in enumerate(texts):
        for gram in _trigrams(text):
            lists.setdefault(gram, []).append(i)
    sizes = np.array([len(_trigrams(text)) for text in texts], dtype=np.int64)
    shared = groups.sparkSession.sparkContext.broadcast((texts, {gram: np.array(at, dtype=np.int64) for gram, at in lists.items()}, sizes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, lists, sizes = shared.value
        unit, low = 10.0**digits, max(0.0, threshold - 10.0**-digits)
        floor = np.full(len(texts), -1.0)  # the k-th best score so far; a later group must exceed it
        kept, rows = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)), None

        @lru_cache(maxsize=64)
        def least(n: int) -> np.ndarray:
            """So many shared trigrams a group of ``n`` needs at least."""
            return np.maximum(1, np.ceil(low / (1 + low) * (n + sizes)).astype(np.int64))

        def prune(parts: list[tuple]) -> tuple:
            which, score, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, -score, which))
            which, score, at = which[order], score[order], at[order]
            place = np.arange(len(which)) - np.searchsorted(which, which)
            floor[which[place == k - 1]] = score[place == k - 1]
            return which[place < k], score[place < k], at[place < k]

        for batch in batches:
            parts, waiting, start = [kept], 0, rows.num_rows if rows else 0
            for at, text in enumerate(batch.column("_words").to_pylist(), start):
                grams = _trigrams(text)
                hits = [lists[g] for g in grams if g in lists]
                if not hits:
                    continue
                s = np.bincount(np.concatenate(hits), minlength=len(sizes))
                which = np.flatnonzero(s >= least(len(grams)))
                s = s[which]
                score = np.floor(s / (len(grams) + sizes[which] - s) * unit + 0.5) / unit
                good = (score >= threshold) & (score > floor[which])
                if good.any():
                    parts.append((which[good], score[good], np.full(np.count_nonzero(good), at)))
                    waiting += len(parts[-1][0])
                if waiting > WAITING_PAIRS:
                    parts, waiting = [prune(parts)], 0
            which, score, at = prune(parts)
            rows = pa.Table.from_batches([*(rows.to_batches() if rows else []), batch])
            used = np.unique(at)
            rows, kept = rows.take(used).combine_chunks(), (which, score, np.searchsorted(used, at))
        if rows:
            which, score, at = kept
            for i in range(0, len(which), 10_000):
                some = rows.take(at[i : i + 10_000]).combine_chunks()
                columns = [pa.array([texts[j] for j in which[i : i + 10_000]], pa.string()), *some.columns, pa.array(score[i : i + 10_000])]
                yield from pa.table(columns, names=["_asked", "_words", "_least", "score"]).to_batches()

    return groups.mapInArrow(search, f"_asked string, _words string, _least {groups.schema['_least'].dataType.simpleString()}, score double")


def reciprocal_rank_fusion(ranked: DataFrame, key: str = "doc_id", stream: str = "stream", rank: str = "rank", k: int = RRF_K, by: Sequence[str] = ()) -> DataFrame:
    """key, score (the sum over streams of 1/(k+rank)), the sorted streams and their ranks; a repeated row of a stream counts once."""
    once = ranked.groupBy(*by, key, stream).agg(F.min(rank).alias(rank))
    parts = F.array_sort(F.collect_list(F.struct(F.col(stream).alias("s"), F.col(rank).alias("r"))))
    fused = once.groupBy(*by, key).agg(parts.alias("p"))
    score = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + F.lit(1.0) / (F.lit(float(k)) + x["r"]))
    return fused.select(*by, key, score.alias("score"), F.transform("p", lambda x: x["s"]).alias("streams"), F.transform("p", lambda x: x["r"]).alias("ranks"))


def with_margin(ranked: DataFrame, by: Sequence[str], key: str = "doc_id", score: str = "score") -> DataFrame:
    """Rank and the distance to the next score (null for the last)."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key)) if by else Window.orderBy(F.desc(score), F.asc(key))
    return ranked.withColumn("rank", F.row_number().over(order)).withColumn("margin", F.round(F.col(score) - F.lead(score).over(order), 6))


def keep_best(frame: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``, chosen by a partial aggregate instead of a sort."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")


def pack(candidates: DataFrame, budget: int, by: Sequence[str] = (), key: str = "doc_id", title: str = "title", body: str = "body", score: str = "score", carry: Sequence[str] = ()) -> DataFrame:
    """Greedy packing into a token budget: by score, then title and key, a block is taken if it still fits, else excluded as over_budget.

    The list that is folded is one query's result page, which its caller bounds; columns named in
    ``carry`` are kept beside each result.
    """
    block = F.concat(F.lit("### "), F.coalesce(title, F.lit("")), F.lit("\n"), X.strip(F.coalesce(body, F.lit(""))))
    item = F.struct((-F.col(score)).alias("o"), F.col(title).alias("t"), F.col(key).alias("k"), X.token_estimate(block).alias("c"), F.struct(*carry, F.lit(0).alias("_")).alias("m"))
    listed = candidates.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = ",".join(f"{c}:{candidates.schema[c].dataType.simpleString()}" for c in carry)
    empty = f"array<struct<k:{candidates.schema[key].dataType.simpleString()},c:int,status:string,m:struct<{kept}{',' if kept else ''}_:int>>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast(empty).alias("out"))

    def take(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["c"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + x["c"]).otherwise(acc["used"]).alias("used"),
            F.concat(acc["out"], F.array(F.struct(x["k"].alias("k"), x["c"].alias("c"), F.when(fits, "packed").otherwise("over_budget").alias("status"), x["m"].alias("m")))).alias("out"),
        )

    folded = listed.select(*by, F.aggregate("items", start, take)["out"].alias("out"))
    return folded.select(*by, F.posexplode("out").alias("position", "x")).select(*by, "position", F.col("x.k").alias(key), F.col("x.c").alias("tokens"), F.col("x.status").alias("status"), *[F.col(f"x.m.{c}").alias(c) for c in carry])


def collapse_versions(results: DataFrame, family: Column, key: str, trust: str, score: str, path: str) -> DataFrame:
    """One result per family with the number of those suppressed: by trust, score, then path."""
    order = Window.partitionBy("family").orderBy(F.desc(trust), F.desc(score), F.asc(F.lower(F.col(path))), F.asc(key))
    whole = Window.partitionBy("family")
    ranked = results.withColumn("family", family).withColumn("_n", F.row_number().over(order)).withColumn("suppressed", F.count(F.lit(1)).over(whole) - 1)
    return ranked.where("_n = 1").drop("_n")
