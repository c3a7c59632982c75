"""Vector expressions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double; null if a vector is null or the lengths differ."""
    a, b = col(a), col(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null where a vector is null or has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
