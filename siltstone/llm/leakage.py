"""Evaluation passages inside a training corpus (problem 8): Wu-Manber search over words.

A word is a run of letters and digits, compared without case. The patterns are all runs of 13
consecutive words of a passage, or the whole passage where it is shorter. Blocks of two words
give the shift table: a block that stands in no pattern lets the search jump by nearly a whole
pattern, a block that ends patterns selects the few to compare in full. Words are numbered, and
what is built from the passages are flat arrays: their words, one hash per pattern in order of
the hashes, and a shift table of hashed blocks in which a collision can only shorten a jump.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.tables import schema_with, table

SHARED_WORDS = 13
#: Bytes of passages that one block of the query set may hold; a larger set is searched block by block.
BLOCK_BYTES = 32 << 20
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.casefold())


STEP = 0x9E3779B97F4A7C15
SPREAD = 2654435761


class Patterns:
    """The patterns of one length: ``shift`` by hashed block, and their starts among the words of all passages by hash."""

    def __init__(self, stream: np.ndarray, begins: np.ndarray, lengths: np.ndarray, size: int):
        self.size, self.block = size, min(2, size)
        self.powers = np.array([pow(STEP, size - 1 - i, 1 << 64) for i in range(size)], dtype=np.uint64)
        words = int(lengths.sum())
        at = np.repeat(begins - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(words)  # places of all words
        place = at - np.repeat(begins, lengths)
        bits = max(12, min(26, (16 * words).bit_length()))
        self.mask = (1 << bits) - 1
        shift = np.full(1 << bits, size - self.block + 1, dtype=np.uint8 if size < 256 else np.int32)
        ends = at[place >= self.block - 1]
        np.minimum.at(shift, self.keys(stream, ends), np.maximum(0, size - 1 - place[place >= self.block - 1]).astype(shift.dtype))
        self.shift = shift.tobytes() if size < 256 else shift.tolist()
        starts = at[place <= np.repeat(lengths, lengths) - size]
        with np.errstate(over="ignore"):
            hashes = np.zeros(len(starts), dtype=np.uint64)
            for i in range(size):
                hashes = hashes * np.uint64(STEP) + stream[starts + i].astype(np.uint64)
        owner = np.searchsorted(begins, starts, "right")
        order = np.lexsort((owner, hashes))
        # a run that a passage repeats is one pattern
        again = np.flatnonzero((hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])) + 1
        for i in range(size):
            again = again[stream[starts[order[again]] + i] == stream[starts[order[again - 1]] + i]]
        order = np.delete(order, again)
        self.hashes, self.starts = hashes[order], starts[order].astype(np.int32 if len(stream) < 1 << 31 else np.int64)

    def keys(self, stream: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = stream[ends].astype(np.uint64)
            if self.block == 2:
                key = stream[ends - 1].astype(np.uint64) * np.uint64(SPREAD) + key
            return key & np.uint64(self.mask)


class WuManber:
    """Passages as numbered words, searched per pattern length."""

    def __init__(self, passages: list[tuple[int, str]], shared: int = SHARED_WORDS):
        self.number: dict[str, int] = {}
        stream, begins, lengths, items = array("i"), [], [], []
        for item, passage in passages:
            words = words_of(passage or "")
            if words:
                begins.append(len(stream))
                lengths.append(len(words))
                items.append(item)
                stream.extend([self.number.setdefault(w, len(self.number)) for w in words])
        self.stream = np.frombuffer(stream, dtype=np.int32) if len(stream) else np.zeros(0, dtype=np.int32)
        self.begins, self.items = np.array(begins, dtype=np.int64), items
        counts = np.array(lengths, dtype=np.int64)
        sizes = np.minimum(counts, shared)
        self.tables = [Patterns(self.stream, self.begins[sizes == s], counts[sizes == s], int(s)) for s in np.unique(sizes)]

    def items_in(self, words: list[str]) -> set[int]:
        found: set[int] = set()
        n = len(words)
        get = self.number.get
        for table in self.tables:
            size, two, shift, mask = table.size, table.block == 2, table.shift, table.mask
            at = size - 1
            while at < n:
                key = get(words[at], -1)
                if key < 0:
                    at += size  # no pattern holds this word
                    continue
                if two:
                    before = get(words[at - 1], -1)
                    if before < 0:
                        at += size - 1
                        continue
                    key += before * SPREAD
                step = shift[key & mask]
                if step:
                    at += step
                    continue
                found |= self.confirmed(table, [get(w, -1) for w in words[at - size + 1 : at + 1]])
                at += 1
        return found

    def confirmed(self, table: Patterns, seen: list[int]) -> set[int]:
        """The items whose pattern is exactly these words."""
        if min(seen) < 0:
            return set()
        if table.block == 2:
            shift, mask, far = table.shift, table.mask, table.size - 1
            if any(shift[(a * SPREAD + b) & mask] == far for a, b in zip(seen, seen[1:], strict=False)):
                return set()  # a block that stands in no pattern
        run = np.array(seen, dtype=np.int32)
        with np.errstate(over="ignore"):
            key = (run.astype(np.uint64) * table.powers).sum(dtype=np.uint64)
        first, last = np.searchsorted(table.hashes, key, "left"), np.searchsorted(table.hashes, key, "right")
        if first == last:
            return set()
        starts = table.starts[first:last].astype(np.int64)
        same = (self.stream[starts[:, None] + np.arange(table.size)] == run).all(axis=1)
        return {self.items[i] for i in np.searchsorted(self.begins, starts[same], "right") - 1}


def leaks(texts: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", shared: int = SHARED_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key`` and ``item`` of each text that shares ``shared`` consecutive words with a passage, each pair once.

    Null, empty and wordless texts or passages share nothing. The passages are the query set:
    they are measured first and searched in blocks of ``block_bytes``, so that what is sent to
    the workers never grows beyond a block. Texts are read whole and never shuffled.
    """
    spark = texts.sparkSession
    wanted = items.where(F.col(passage).isNotNull() & F.col(item).isNotNull()).select(item, passage)
    size = wanted.agg(F.coalesce(F.sum(F.octet_length(passage)), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    schema = schema_with(texts, key, "_item array<bigint>")
    found = None
    for number in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == number)
        matcher = spark.sparkContext.broadcast(WuManber([(r[0], r[1]) for r in part.collect()], shared))

        def search(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [sorted(matcher.value.items_in(words_of(t))) if t else [] for t in batch.column(1).to_pylist()]
                keep = pa.array([bool(h) for h in hits])
                out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int64()))], names=[key, "_item"])
                yield out.filter(keep)

        one = texts.where(F.col(text).isNotNull()).select(key, text).mapInArrow(search, schema)
        found = one if found is None else found.unionByName(one)
    return found.select(key, F.explode("_item").alias(item)).distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


QUERIES = {"p8_found": p8_found}
SQL = {
    "p8_found": """
WITH passages AS (
  SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL AND item_id IS NOT NULL
), sized AS (
  SELECT item_id, w, least(13, len(w)) AS size FROM passages WHERE len(w) > 0
), patterns AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS run FROM sized, unnest(range(1, len(w) - size + 2)) AS r(i)
), texts AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), runs AS (
  SELECT doc_id, size, array_to_string(w[i : i + size - 1], ' ') AS run
  FROM texts, (SELECT DISTINCT size FROM sized), unnest(range(1, len(w) - size + 2)) AS r(i)
)
SELECT DISTINCT doc_id, item_id FROM runs JOIN patterns USING (size, run)
"""
}
