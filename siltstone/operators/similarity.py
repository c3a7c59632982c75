"""Duplicate pairs and clusters over vectors, without comparing all pairs of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import vectors as V
from siltstone.session import cut_lineage


def exact_duplicates(frame: DataFrame, key: str, content: str) -> DataFrame:
    """key, canonical (the least key of equal contents) and duplicates (their number besides the canonical one).

    The group is reduced to its least key and size before it is joined back, so a content that
    a third of the rows share is never gathered. Null contents are duplicates of nothing.
    """
    digest = frame.where(F.col(content).isNotNull()).select(key, F.sha2(F.col(content).cast("binary"), 256).alias("h"))
    groups = digest.groupBy("h").agg(F.min(key).alias("canonical"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return digest.join(groups, "h").select(key, "canonical", "duplicates")


TILE = 512


def representatives(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", block: str = "label") -> DataFrame:
    """key and rep of each vector that has a length: rep is the least key of the equal vectors of its block."""
    unit = unit_rows(vectors, key, vector, block)
    reps = unit.groupBy(block, "_v").agg(F.min(key).alias("rep"))
    return unit.join(reps, [block, "_v"]).select(F.col(key).alias("key"), "rep").distinct()


def unit_rows(vectors: DataFrame, key: str, vector: str, block: str) -> DataFrame:
    return vectors.where(V.norm(vector) > 0).select(block, key, F.transform(F.col(vector), lambda x: x.cast("double")).alias("_v"))


def cosine_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block: str = "label") -> DataFrame:
    """a, b and similarity of all pairs of one block with cosine at or above the threshold, a < b.

    Exact. Pairs of representatives are found first and handed to all their copies; the pairs of
    equal vectors come with them, so many copies give many rows. Vectors that are null or
    without length pair with nothing.
    """
    pairs = representative_pairs(vectors, threshold, key, vector, block)
    members = cut_lineage(representatives(vectors, key, vector, block))
    one, two = (members.select(F.col("key").alias(f"k{n}"), F.col("rep").alias(f"r{n}")) for n in "ab")
    spread = pairs.join(one, F.col("a") == F.col("ra")).join(two, F.col("b") == F.col("rb")).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity")
    if threshold > 1:
        return spread
    equal = one.join(two, F.col("ra") == F.col("rb")).where("ka < kb").select(F.col("ka").alias("a"), F.col("kb").alias("b"), F.lit(1.0).alias("similarity"))
    return spread.unionByName(equal)


def cosine_links(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block: str = "label") -> DataFrame:
    """a and b of links that join the same vectors as all of ``cosine_pairs``, but only one for each copy."""
    links = representative_pairs(vectors, threshold, key, vector, block).select("a", "b")
    if threshold > 1:
        return links
    return links.unionByName(representatives(vectors, key, vector, block).where("rep < key").select(F.col("rep").alias("a"), F.col("key").alias("b")))


def representative_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block: str = "label") -> DataFrame:
    """a, b and similarity of the pairs of ``cosine_pairs`` among the representatives.

    Equal vectors are one representative (the least key of each); the rest of a
    block is cut into tiles of about ``TILE`` rows, ordered along a fixed direction. Unit vectors
    with cosine >= t differ by at most sqrt(2 - 2t) along any direction, so only tiles whose
    ranges come that close meet, and two tiles meet as one matrix product: pairs below the
    threshold are never rows.
    """
    reps = unit_rows(vectors, key, vector, block).groupBy(block, "_v").agg(F.min(key).alias("k"))
    dims = reps.select(F.max(F.size("_v"))).first()[0] or 1
    direction = np.random.RandomState(11).normal(size=dims)
    direction /= np.linalg.norm(direction)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    weights = F.array(*[F.lit(float(x)) for x in direction])
    placed = reps.withColumn("p", V.dot("_v", weights) / V.norm("_v"))
    counts = reps.groupBy(block).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / TILE)).cast("int").alias("tiles"))
    # a tile is a slice of the projections' range; within a slice that is still too full, rows are dealt out by hash
    sized = placed.join(counts, block).withColumn("t", F.struct(F.floor((F.col("p") + 1) * 8).alias("slice"), F.pmod(F.xxhash64("k"), F.col("tiles")).alias("deal")))
    tiles = cut_lineage(sized.groupBy(block, "t").agg(F.collect_list(F.struct("k", "_v")).alias("rows"), F.min("p").alias("low"), F.max("p").alias("high")))
    # tiles meet by their names first, slice by slice, and fetch their rows afterwards, so that a large block is as many tasks as it has pairs of tiles
    names = tiles.select(block, "t", "low", "high")
    slices = F.sequence(F.floor((F.col("low") - reach + 1) * 8), F.floor((F.col("high") + reach + 1) * 8))
    a = names.select(F.col(block).alias("_b"), F.col("t").alias("ta"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(slices).alias("slice"))
    b = names.select(F.col(block).alias("_b"), F.col("t").alias("tb"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.col("t.slice").alias("slice"))
    pairs = a.join(b, ["_b", "slice"]).where("ta <= tb").where((F.col("lb") - F.col("ha") <= reach) & (F.col("la") - F.col("hb") <= reach)).select("_b", "ta", "tb")
    left = tiles.select(F.col(block).alias("_b"), F.col("t").alias("ta"), F.col("rows").alias("ra"))
    right = tiles.select(F.col(block).alias("_b"), F.col("t").alias("tb"), F.col("rows").alias("rb"))
    met = pairs.join(left, ["_b", "ta"]).join(right, ["_b", "tb"])
    kind = vectors.schema[key].dataType.simpleString()

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one, two, same in zip(batch["ra"], batch["rb"], batch["same"], strict=True):
                ka, kb = [r["k"] for r in one], [r["k"] for r in two]
                sizes = {len(r["_v"]) for r in one} | {len(r["_v"]) for r in two}
                for size in sizes:
                    ia = [i for i, r in enumerate(one) if len(r["_v"]) == size]
                    ib = [i for i, r in enumerate(two) if len(r["_v"]) == size]
                    if not ia or not ib:
                        continue
                    ma, mb = (np.array([rows[i]["_v"] for i in ix]) for rows, ix in ((one, ia), (two, ib)))
                    ma /= np.linalg.norm(ma, axis=1, keepdims=True)
                    mb /= np.linalg.norm(mb, axis=1, keepdims=True)
                    close = ma @ mb.T
                    x, y = np.nonzero(close >= threshold)
                    rows = [(min(ka[ia[i]], kb[ib[j]]), max(ka[ia[i]], kb[ib[j]]), float(close[i, j])) for i, j in zip(x, y, strict=True) if not same or ka[ia[i]] < kb[ib[j]]]
                    yield pd.DataFrame(rows, columns=["a", "b", "similarity"])

    return met.select("ra", "rb", (F.col("ta") == F.col("tb")).alias("same")).mapInPandas(multiply, f"a {kind}, b {kind}, similarity double")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node and component (its least node), by large-star / small-star contraction.

    Both directions of an edge are aggregated to the least neighbour, so no neighbourhood is
    gathered; the lineage is cut in each round through the shared checkpoint folder. The number
    of rounds grows with the logarithm of the longest path; should the limit not suffice, an
    error says so rather than a wrong result.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = both.select("u").union(both.select("v")).distinct()
    current = both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    for _ in range(rounds):
        mirrored = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = mirrored.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = mirrored.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        current = cut_lineage(small)
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return nodes.join(current, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


def cluster_canonical(components: DataFrame, ranks: DataFrame, key: str, order: list) -> DataFrame:
    """The member that stands for each component."""
    joined = components.join(ranks, components["node"] == ranks[key])
    window = Window.partitionBy("component").orderBy(*order, F.asc("node"))
    return joined.withColumn("_n", F.row_number().over(window)).where("_n = 1").select("component", F.col("node").alias("canonical"))
