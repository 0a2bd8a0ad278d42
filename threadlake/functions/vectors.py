"""Vector functions as Spark columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector is zero."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length).otherwise(0.0)


def hash_embedding(text: Column, buckets: int = 32) -> Column:
    """Counts of code points modulo ``buckets``, scaled to length 1. Each bucket is one pass of built-in functions."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c) % buckets)
    counts = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(codes, lambda x: x == b)).cast("double"))
    return unit(counts)
