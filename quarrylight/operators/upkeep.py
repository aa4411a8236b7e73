"""Resuming builds, cached answers, timings: what keeps a scene database going."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def still_to_do(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(done, keys, "left_anti")


def resumable(meta: DataFrame, vectors: DataFrame) -> bool:
    """Whether an earlier output can be built on: ids count from 0 and every row has its vector."""
    ids = meta.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d")).first()
    if not ids["n"]:
        return False
    return ids["a"] == 0 and ids["b"] == ids["n"] - 1 and ids["d"] == ids["n"] and vectors.count() == ids["n"]


def reusable(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions))


def truncated(response: Column) -> Column:
    """Whether any choice of a model's answer ended for length."""
    choices = F.from_json(response, "struct<choices:array<struct<finish_reason:string>>>")["choices"]
    return F.coalesce(F.exists(choices, lambda c: F.lower(F.trim(c["finish_reason"])) == "length"), F.lit(False))


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests with a whole cached answer, and those without."""
    good = cache.where(~truncated(F.col("response")))
    return requests.join(good, key), requests.join(good, key, "left_anti")


def promoted(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """One cache of two layouts; the new one's entry stays."""
    return new.unionByName(old.join(new, key, "left_anti"))


def first_success(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The first attempt that is ok, else the first of all."""
    others = [c for c in attempts.columns if c not in keys]
    return attempts.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(F.col("status") != "ok", "attempt")).alias("_r")).select(*keys, "_r.*")


def timing_averages(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, mean, n) of the columns."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns))
    return rows.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").groupBy("metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def projection_bounds(points: DataFrame, pad: float = 0.5) -> DataFrame:
    """Bounds of (x, z) widened by ``pad``; a side without extent becomes a metre wide."""
    b = points.where("x is not null and z is not null").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in "xz" for f in (F.min, F.max)))
    out = b.select(*((F.col(f"min_{c}") - pad).alias(f"min_{c}") for c in "xz"), *((F.col(f"max_{c}") + pad).alias(f"max_{c}") for c in "xz"))
    return out.withColumns({f"max_{c}": F.when(F.col(f"max_{c}") - F.col(f"min_{c}") < 1e-6, F.col(f"min_{c}") + 1).otherwise(F.col(f"max_{c}")) for c in "xz"})


def overlay_groups(scored: DataFrame) -> DataFrame:
    """(x, z) on a millimetre grid with the best score of each orientation and the best orientation."""
    best = scored.groupBy(F.bround("x", 3).alias("x"), F.bround("z", 3).alias("z"), "orientation").agg(F.max("score").alias("score"))
    return best.groupBy("x", "z").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("orientation", "score")))).alias("scores"), F.max_by("orientation", F.struct("score", -F.col("orientation"))).alias("best_orientation"), F.max("score").alias("best"))


def display_values(cells: DataFrame, value: str, gain: float = 24.0) -> DataFrame:
    """Cells on [0, 1] by their range, and on a log scale."""
    bounds = cells.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return cells.crossJoin(F.broadcast(bounds)).withColumn("linear", share).withColumn("log", F.log1p(F.col("linear") * gain) / F.log1p(F.lit(gain))).drop("_lo", "_hi")


def anchor_poses(anchors: DataFrame, radius: float = 1.0) -> DataFrame:
    """Four camera poses around each anchor (anchor_id, x, z), facing it."""
    poses = F.array(*(F.struct(F.lit(n).alias("side"), F.lit(dx * radius).alias("dx"), F.lit(dz * radius).alias("dz"), F.lit(yaw).alias("orientation")) for n, dx, dz, yaw in (("north", 0.0, -1.0, 180), ("east", 1.0, 0.0, 90), ("south", 0.0, 1.0, 0), ("west", -1.0, 0.0, 270))))
    return anchors.withColumn("p", F.explode(poses)).select("anchor_id", "p.side", (F.col("x") + F.col("p.dx")).alias("x"), (F.col("z") + F.col("p.dz")).alias("z"), "p.orientation")
