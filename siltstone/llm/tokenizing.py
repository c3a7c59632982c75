"""Token ids of a public byte-level BPE vocabulary (problem 7).

Merging uses a queue of merge ranks instead of a heap: for each rank a bucket of positions in
the linked list of the pre-token's parts, and above the buckets a hierarchical bitmap whose
first set bit is the next rank. A merge only invalidates entries lazily; an entry whose pair
has changed since is skipped when its bucket comes up. The work per merge is constant, so a
pre-token of n bytes costs O(n) merges even where n runs into the tens of thousands.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from siltstone.tables import schema_with, table

#: The pre-token pattern published with the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the pattern means for texts of ASCII characters only, in the faster of the two regular-expression libraries.
ASCII = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
VOCABULARY = os.environ.get("SILTSTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Entries a worker remembers; when full it starts afresh, which changes time only.
CACHE = 400_000
CACHED_BYTES = 64


class RankQueue:
    """Buckets of positions per rank below a bitmap of three levels; ``pop`` empties the lowest bucket."""

    WIDTH = 64

    def __init__(self, ranks: int):
        words = -(-ranks // self.WIDTH)
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * words
        self.mid = [0] * -(-words // self.WIDTH)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, list[int]] | None:
        if not self.top:
            return None
        group = (self.top & -self.top).bit_length() - 1
        word = (group << 6) + (self.mid[group] & -self.mid[group]).bit_length() - 1
        rank = (word << 6) + (self.low[word] & -self.low[word]).bit_length() - 1
        self.low[word] &= self.low[word] - 1
        if not self.low[word]:
            self.mid[group] &= ~(1 << (word & 63))
            if not self.mid[group]:
                self.top &= ~(1 << group)
        return rank, self.buckets.pop(rank)


class Encoder:
    """Byte-level BPE over a table of token bytes to rank; the rank is the token's id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.ascii = re.compile(ASCII).findall if pattern == PATTERN else None
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.known = Known(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = bytearray(b"\x01") * n
        queue, get = self.queue, ranks.get
        wanted = [-1] * n
        for i in range(n - 1):
            if (rank := get(piece[i : i + 2])) is not None:
                wanted[i] = rank
                queue.push(rank, i)
        while (entry := queue.pop()) is not None:
            rank, positions = entry
            positions.sort()
            for i in positions:
                if not alive[i] or wanted[i] != rank:
                    continue  # stale
                gone = after[i]
                end = after[gone]
                alive[gone] = 0
                after[i] = end
                if end < n:
                    before[end] = i
                    found = get(piece[i : after[end]])
                    wanted[i] = -1 if found is None else found
                    if found is not None:
                        queue.push(found, i)
                else:
                    wanted[i] = -1
                if (left := before[i]) >= 0:
                    found = get(piece[left:end])
                    wanted[left] = -1 if found is None else found
                    if found is not None:
                        queue.push(found, left)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def encode(self, text: str) -> list[int]:
        find = self.ascii if self.ascii is not None and text.isascii() else self.find
        return list(chain.from_iterable(map(self.known.__getitem__, find(text))))


class Known(dict):
    """Ids of the pre-tokens seen; a new one is merged when it is first asked for."""

    def __init__(self, merge: Callable[[bytes], list[int]]):
        self.merge = merge

    def __missing__(self, token: str) -> list[int]:
        raw = token.encode("utf-8", "replace")
        ids = self.merge(raw)
        if len(raw) <= CACHED_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[token] = ids
        return ids


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def token_ids(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``key`` and ids (array<int>) of each row, without special tokens.

    A null text gives null, an empty one an empty list; strings of special tokens are ordinary
    text. ``vocabulary`` and ``pattern`` name any byte-level vocabulary and its pre-tokens. Rows are independent: repeated rows give repeated results, an empty table none, and
    other columns are not read. The vocabulary is read once on the driver and sent to the
    workers; its size is that of the published file (under 1 MB), whatever the corpus.
    """
    ranks = texts.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    schema = schema_with(texts, key, "ids array<int>")
    names = [key, "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for batch in batches:
            ids = [None if t is None else encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=names)

    return texts.select(key, text).mapInArrow(encode, schema)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents"))


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
