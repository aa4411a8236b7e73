"""Pairs of objects within a group: similarities, affinity rules, neighbour graphs.

A pair table has one row for each unordered pair of a group, i < j. Groups are the equi-key of the self-join, so work
grows with the square of a group, never of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles
from ..functions.vectors import dot, l2_normalised


def clip(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def pairs(rows: DataFrame, group: str, carry: list[str]) -> DataFrame:
    """(group, i, j, i_*, j_*) for i < j; ``rows`` has ``object_global_id`` and the columns to carry."""
    side = lambda p: rows.select(group, F.col("object_global_id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in carry))
    return side("i").join(side("j"), group).where("i < j")


def text_similarity(rows: DataFrame, group: str, carry: tuple[str, ...] = ("view_id",)) -> DataFrame:
    """Cosines within [-1, 1]."""
    unit = rows.withColumn("unit", l2_normalised(F.col("vec")))
    return pairs(unit, group, ["unit", *carry]).withColumn("sim", clip(dot(F.col("i_unit"), F.col("j_unit")), -1.0, 1.0)).drop("i_unit", "j_unit")


def same_view() -> Column:
    return F.coalesce((F.col("i_view_id") == F.col("j_view_id")) & (F.col("i_view_id") != ""), F.lit(False))


def view_policy(value: Column, policy: str, penalty: float) -> Column:
    """What pairs of one view are worth: as they are, less, or nothing."""
    kinds = {"none": value, "soft_penalty": F.when(same_view(), value * penalty).otherwise(value), "hard_block": F.when(same_view(), 0.0).otherwise(value)}
    if policy not in kinds:
        raise ValueError(f"no such policy: {policy}")
    return kinds[policy]


def constrained(sims: DataFrame, group: str, policy: str = "soft_penalty", penalty: float = 0.8, least: float | None = None, top_k: int | None = None) -> DataFrame:
    """Affinity: policy, then clipped to [0, 1], then a threshold on the similarity as it was, then each node's best."""
    value = clip(view_policy(F.col("sim"), policy, penalty), 0.0, 1.0)
    if least is not None:
        value = F.when(F.col("sim") >= least, value).otherwise(0.0)
    out = sims.withColumn("affinity", value)
    if top_k is None:
        return out
    kept = both_ways(out, group, "affinity").where("w > 0")
    order = Window.partitionBy(group, "a").orderBy(F.desc("w"), "b")
    chosen = kept.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_k).select(group, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()
    marked = out.join(chosen.withColumn("_in", F.lit(True)), [group, "i", "j"], "left")
    return marked.withColumn("affinity", F.when(F.col("_in"), F.col("affinity")).otherwise(0.0)).drop("_in")


def multi_view(sims: DataFrame, penalty: float = 0.8, least: float = 0.60) -> DataFrame:
    """Clipped first, then the penalty for one view, then the threshold on the similarity as it was."""
    clipped = clip(F.col("sim"), 0.0, 1.0)
    return sims.withColumn("affinity", F.when(F.col("sim") < least, 0.0).when(same_view(), clipped * penalty).otherwise(clipped))


def both_ways(table: DataFrame, group: str, value: str) -> DataFrame:
    """(group, a, b, w) in both directions."""
    return table.select(group, F.col("i").alias("a"), F.col("j").alias("b"), F.col(value).alias("w")).unionByName(table.select(group, F.col("j").alias("a"), F.col("i").alias("b"), F.col(value).alias("w")))


def knn_graph(sims: DataFrame, group: str, k: int = 6) -> DataFrame:
    """Each node's k most similar; the mean of both directions, a missing one as 0; clipped to [0, 1]."""
    order = Window.partitionBy(group, "a").orderBy(F.desc("w"), "b")
    kept = both_ways(sims, group, "sim").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return kept.groupBy(group, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(clip(F.sum("w") / 2, 0.0, 1.0).alias("weight"))


def geometry(rows: DataFrame, group: str, carry: tuple[str, ...] = ("view_id",), sigma_2d: float = 2.0, sigma_3d: float = 2.5) -> DataFrame:
    """Gaussian similarity of positions: in space where both heights are known, else on the floor; null where unknown."""
    both = pairs(rows, group, ["gx", "gy", "gz", *carry])
    dx, dy, dz = (F.col(f"j_{c}") - F.col(f"i_{c}") for c in ("gx", "gy", "gz"))
    flat, space = F.hypot(dx, dz), F.sqrt(dx * dx + dy * dy + dz * dz)
    return both.withColumns({
        "distance_2d": flat, "distance_3d": F.coalesce(space, flat), "used_3d": F.coalesce(dy.isNotNull() & flat.isNotNull(), F.lit(False)),
        "geometry": F.coalesce(angles.gaussian(space, sigma_3d), angles.gaussian(flat, sigma_2d)),
    })


def fused(sims: DataFrame, geo: DataFrame, group: str, w_text: float = 0.7, w_geo: float = 0.3, policy: str = "soft_penalty", penalty: float = 0.8) -> DataFrame:
    """Text and geometry by weight, text alone where there is no geometry; then the policy for pairs of one view."""
    total = w_text + w_geo
    both = sims.join(geo.select(group, "i", "j", "geometry", "distance_2d", "distance_3d", "used_3d"), [group, "i", "j"])
    before = F.when(F.col("geometry").isNotNull(), F.col("sim") * (w_text / total) + F.col("geometry") * (w_geo / total)).otherwise(F.col("sim"))
    return both.withColumn("fused", before).withColumn("fused_after", view_policy(F.col("fused"), policy, penalty))


def weighted_affinity(parts: list[tuple[Column, float]]) -> Column:
    """Sum of weight times score over the weights of the scores that are there; 0 if none is."""
    have = [F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in parts]
    got = [F.coalesce(s * w, F.lit(0.0)) for s, w in parts]
    total = sum(have[1:], have[0])
    return F.when(total > 0, sum(got[1:], got[0]) / total).otherwise(0.0)


def polar_similarity(d_distance: Column, d_bearing: Column, d_height: Column) -> Column:
    """Over the dimensions that are there, on scales of 2 m, 45 degrees and 1 m; null if none is."""
    parts = [d_distance / 2.0, angles.wrapped_delta(d_bearing) / 45.0, d_height / 1.0]
    squares = [F.coalesce(p * p, F.lit(0.0)) for p in parts]
    count = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    return F.when(count > 0, F.exp(-(squares[0] + squares[1] + squares[2])))
