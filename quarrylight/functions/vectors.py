"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalised(v: Column, eps: float = 1e-12) -> Column:
    """The vector over its length, or over ``eps`` if it is shorter."""
    length = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x / length)


def mean_vector(df, keys: list[str], vector: str, out: str):
    """Mean of the vectors of each group; coordinates are averaged apart and put together in order."""
    each = df.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
    packed = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v"))
    return packed.select(*keys, F.transform("_v", lambda s: s["_x"]).alias(out))
