"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length; the longer vector is cut."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def hash_embedding(text: Column, dimension: int = 1536) -> Column:
    """A stand-in for a model: bytes of sha256 over and over, scaled to [-1, 1], of unit length."""
    one = lambda value, fn: F.element_at(F.transform(F.array(value), fn), 1)  # noqa: E731  (value is worked out once, not for each number)
    raw = one(F.sha2(text, 256), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.conv(F.substr(h, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1))
    pair = one(raw, lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    return one(pair, lambda p: F.transform(p["v"], lambda x: F.when(p["n"] > 0, x / p["n"]).otherwise(x)))
