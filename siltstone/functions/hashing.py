"""Keys and hashes."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import col

NUL = "\u0000"


def sha(c: Column | str) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def quick_hash(name: Column | str, size: Column | str, mtime_ns: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", col(name), col(size).cast("string"), col(mtime_ns).cast("string")), 256)


def cache_key(model: Column | str, dims: Column | int, text: Column | str) -> Column:
    dims = F.lit(dims) if isinstance(dims, int) else dims
    return F.sha2(F.concat_ws(NUL, col(model), dims.cast("string"), sha(text)), 256)


def query_hash(c: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), sha(c))


def document_id(table: Column | str, key: Column | str) -> Column:
    """``table--id`` with every other character than letters, digits, ``_`` and ``-`` replaced by ``_``."""
    return F.regexp_replace(F.concat_ws("--", col(table), col(key).cast("string")), "[^A-Za-z0-9_-]", "_")


def job_identity(kind: Column | str, *stable: Column | str) -> Column:
    """Hash of a job's type and the parts of its payload that do not change between attempts."""
    return F.sha2(F.concat_ws(NUL, col(kind), *[F.coalesce(col(c).cast("string"), F.lit("")) for c in stable]), 256)


_TOKEN = re.compile(r"[a-z0-9]+")


def token_hash_vector(text: str | None, dims: int = 256) -> list[float] | None:
    """Deterministic embedding: FNV-1a 64 of each token picks a dimension by its low byte and a sign by its top bit."""
    if text is None:
        return None
    values = np.zeros(dims, dtype=np.float32)
    for token in _TOKEN.findall(unicodedata.normalize("NFKC", text).lower()) or ["empty"]:
        h = 0xCBF29CE484222325
        for byte in token.encode():
            h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        values[h & 0xFF] += -1.0 if h >> 63 else 1.0
    norm = math.sqrt(float((values.astype(np.float64) ** 2).sum()))
    if norm == 0:
        values[0], norm = 1.0, 1.0
    return (values / np.float32(norm)).tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def token_hash_embedding(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(token_hash_vector)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC, lower case, LF: the normal form that text artifacts are hashed in."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower().replace("\r\n", "\n").replace("\r", "\n"))
