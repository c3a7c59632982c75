"""A Bloom filter over a column of any size, built by the workers and sized by the number of terms.

It has ``BITS_PER_TERM`` bits a term, which lets fewer than 1 % of other terms pass, up to
``MOST_BITS`` (16 MB, enough for eight million terms); beyond that more pass, never fewer. What
passes is always decided by a join with the terms themselves, so its size is a matter of
traffic, not of results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
BITS_PER_TERM = 16
HASHES = 4


def positions(term: str, mask: int) -> list[int]:
    raw = hashlib.blake2b(term.encode("utf-8", "replace"), digest_size=4 * HASHES).digest()
    return [int.from_bytes(raw[4 * i : 4 * i + 4], "little") & mask for i in range(HASHES)]


def size_for(terms: int) -> int:
    """Bits of a filter of so many terms, a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, terms * BITS_PER_TERM - 1).bit_length()))


def build(terms: DataFrame, column: str = "term") -> bytes:
    """The filter's bits, ``size_for`` the approximate number of distinct terms; null terms are left out."""
    terms = terms.select(column).where(F.col(column).isNotNull())
    size = size_for(int(terms.agg(F.approx_count_distinct(column)).first()[0]))
    mask = size - 1

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.array([p for t in batch[column] for p in positions(t, mask)], dtype=np.int64)
            yield pd.DataFrame({"slot": (at >> 6).astype(np.int32), "bit": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    words = terms.mapInPandas(slots, "slot int, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(size // 64, dtype=np.int64)
    table[words["slot"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return table.tobytes()


class Member:
    """Membership with a memory of the words already asked for; the memory is emptied when full."""

    def __init__(self, bits: bytes, memory: int = 200_000):
        self.bits, self.mask, self.memory, self.known = bits, 8 * len(bits) - 1, memory, {}

    def __call__(self, term: str) -> bool:
        hit = self.known.get(term)
        if hit is None:
            bits = self.bits
            hit = all(bits[p >> 3] >> (p & 7) & 1 for p in positions(term, self.mask))
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[term] = hit
        return hit
