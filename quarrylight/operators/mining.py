"""Candidate pairs for labelling: which objects may or may not be one instance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.texts import jaccard, tokens
from ..storage import materialise

# Wording that hints at a reflection or a view into another room.
TRICKY_WORDS = ("reflection", "background", "doorway", "adjacent", "visible through", "mirror", "tv reflection")


def is_tricky(*texts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *texts)).rlike("|".join(TRICKY_WORDS))


def _near(distance: Column, reach: float) -> Column:
    return F.when(distance.isNotNull(), F.greatest(F.lit(0.0), 1 - F.least(distance, F.lit(reach)) / reach)).otherwise(0.0)


def _first(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n rows of each key with the smallest identifiers."""
    order = Window.partitionBy(*keys).orderBy("object_global_id")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    a, b = (rows.select(*(F.col(c).alias(f"{s}_{c}") for c in rows.columns)) for s in "ab")
    return a, b


def _equal(*columns: str) -> Column:
    """Both sides agree, and the first side has the smaller identifier."""
    on = F.col("a_object_global_id") < F.col("b_object_global_id")
    for c in columns:
        on = on & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return on


OUT = "bucket string, score double, obj_a_id long, obj_b_id long, a_label string, b_label string, a_place_id string, b_place_id string"
#: Distances within which distant pairs are looked for, one after the other.
REACHES = (0.01, 0.1, 1.0, 10.0)


def _distant_pairs(rows: DataFrame, adjacent: DataFrame, n: int) -> list:
    """The first n pairs of one label that are in different places which are not adjacent, best first.

    Their score is the overlap of tokens, 1 at most, plus a share for a distance below 10. Nothing else tells objects with
    equal tokens apart where distances do not count, so of those only the ones with the smallest identifiers can be in
    the first pairs: n, and as many as one object can have of its label in its own and adjacent places. Of objects with
    equal tokens, place and position it is n + 1. Near pairs meet in grid cells, which grow until the n-th score is above
    what the cells leave out; texts that differ meet only where equal ones do not give n pairs.
    """
    there = adjacent.select(F.col("a_place_id"), F.col("b_place_id"))
    here = rows.groupBy("place_id", "label").agg(F.count(F.lit(1)).alias("n"))
    around = here.select(F.col("place_id").alias("b_place_id"), "label", "n").join(there, "b_place_id").groupBy(F.col("a_place_id").alias("place_id"), "label").agg(F.sum("n").alias("m"))
    most = here.where("place_id is not null").join(around, ["place_id", "label"], "left").agg(F.max(F.col("n") + F.coalesce("m", F.lit(0))).alias("most")).first()["most"] or 0
    best: dict[tuple[int, int], tuple] = {}

    def add(pairs: DataFrame) -> None:
        apart = pairs.where(~F.coalesce(F.col("a_place_id") == F.col("b_place_id"), F.lit(False))).join(there, ["a_place_id", "b_place_id"], "left_anti")
        distance = F.hypot(F.col("a_gx") - F.col("b_gx"), F.col("a_gz") - F.col("b_gz"))
        scored = apart.withColumn("score", F.round(jaccard(F.col("a_tokens"), F.col("b_tokens")) + _near(distance, 10.0), 9))
        out = scored.select(F.lit("same_label_distant_place").alias("bucket"), "score", F.col("a_object_global_id").alias("obj_a_id"), F.col("b_object_global_id").alias("obj_b_id"), "a_label", "b_label", "a_place_id", "b_place_id")
        found = best | {(r["obj_a_id"], r["obj_b_id"]): tuple(r) for r in out.orderBy(F.desc("score"), "obj_a_id", "obj_b_id").limit(n).collect()}
        first = sorted(found.items(), key=lambda p: (-p[1][1], *p[0]))[:n]
        best.clear()
        best.update(first)

    def least() -> float:
        return min(p[1] for p in best.values()) if len(best) >= n else float("-inf")

    alike = materialise(_first(rows, ["label", "tokens"], n + most), "alike-objects")
    a, b = _sides(alike)
    add(a.join(b, _equal("label", "tokens")))
    if least() < 1:
        add(a.join(b, _equal("label")))
    placed = materialise(_first(rows.where("gx is not null and gz is not null"), ["label", "tokens", "gx", "gz", "place_id"], n + 1), "placed-objects")
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a, b = _sides(placed)
    for reach in REACHES:
        cell = lambda c: F.floor(F.col(c) / reach).cast("long")  # noqa: B023, E731
        around = a.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumns({"_i": cell("a_gx") + F.col("_i"), "_j": cell("a_gz") + F.col("_j")})
        near = around.join(b.withColumns({"_k": cell("b_gx"), "_l": cell("b_gz")}), _equal("label") & (F.col("_i") == F.col("_k")) & (F.col("_j") == F.col("_l")))
        add(near.where(F.hypot(F.col("a_gx") - F.col("b_gx"), F.col("a_gz") - F.col("b_gz")) < reach))
        if least() > 2 - reach / 10 + 1e-8:
            break
    return list(best.values())


def candidate_pairs(objects: DataFrame, edges: DataFrame, per_bucket: int = 50) -> DataFrame:
    """The best pairs of each bucket: same label in one place, adjacent places or distant ones; different labels in one place.

    Pairs of a place come from equi-joins on it, those of adjacent places through the edges; distant ones, which are most of
    all pairs of a label, are looked for by what can be among the best (see ``_distant_pairs``).
    """
    rows = objects.withColumn("tokens", F.array_sort(tokens(F.col("label"), F.col("description"))))
    rows = rows.select("object_global_id", "label", "place_id", "view_id", "gx", "gz", "laterality", "distance_bin", "verticality", "tokens")
    one_way = edges.select(F.col("source").alias("a_place_id"), F.col("target").alias("b_place_id"))
    adjacent = materialise(one_way.union(one_way.select("b_place_id", "a_place_id")).distinct(), "adjacent-places")
    a, b = _sides(rows)
    distance = F.hypot(F.col("a_gx") - F.col("b_gx"), F.col("a_gz") - F.col("b_gz"))
    overlap = jaccard(F.col("a_tokens"), F.col("b_tokens"))
    same = lambda c: F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), 1.0).otherwise(0.0)
    one_place = a.join(b, _equal("place_id"))
    here = one_place.where("a_label = b_label").withColumn("bucket", F.lit("same_label_same_place")).withColumn("score", 1.5 + overlap + F.when(F.col("a_view_id") != F.col("b_view_id"), 0.25).otherwise(0.0) + _near(distance, 4.0))
    beside = a.join(adjacent.where("a_place_id <> b_place_id"), "a_place_id").join(b.withColumnRenamed("b_place_id", "_place"), (F.col("b_place_id") == F.col("_place")) & _equal("label"))
    beside = beside.withColumn("bucket", F.lit("same_label_adjacent_place")).withColumn("score", 1.0 + overlap + _near(distance, 6.0))
    different = one_place.where("a_label <> b_label").withColumn("bucket", F.lit("different_label_same_place")).withColumn("score", 0.25 + 0.5 * same("distance_bin") + 0.25 * same("laterality") + 0.25 * same("verticality"))
    out = ["bucket", F.round("score", 9).alias("score"), F.col("a_object_global_id").alias("obj_a_id"), F.col("b_object_global_id").alias("obj_b_id"), "a_label", "b_label", "a_place_id", "b_place_id"]
    distant = objects.sparkSession.createDataFrame(_distant_pairs(rows, adjacent, per_bucket), OUT)
    both = here.select(*out).unionByName(beside.select(*out)).unionByName(different.select(*out)).unionByName(distant)
    order = Window.partitionBy("bucket").orderBy(F.desc("score"), "obj_a_id", "obj_b_id")
    best = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_bucket)
    return best.withColumn("suggested_same", F.col("bucket").isin("same_label_same_place", "same_label_adjacent_place"))


def tricky_pairs(objects: DataFrame, per_bucket: int = 50) -> DataFrame:
    """Pairs of one label of which one has tricky wording. As an exclusive bucket this is empty, for pairs of one label
    always fall into an earlier one; here pairs of other buckets are not taken out.

    Objects with equal label, tokens and wording differ by identifier alone, so of them the first ``per_bucket`` + 1 are
    enough. Different tokens meet only where equal ones do not give all pairs, since nothing scores higher than these.
    """
    rows = objects.select("object_global_id", "label", F.array_sort(tokens(F.col("label"), F.col("description"))).alias("tokens"), is_tricky(F.col("description")).alias("tricky"))
    few = materialise(_first(rows, ["label", "tokens", "tricky"], per_bucket + 1), "tricky-objects")
    a, b = _sides(few)
    score = F.round(1.5 + jaccard(F.col("a_tokens"), F.col("b_tokens")), 9)

    def best(on: Column) -> DataFrame:
        pairs = a.join(b, on).where("a_tricky or b_tricky").select(F.col("a_object_global_id").alias("obj_a_id"), F.col("b_object_global_id").alias("obj_b_id"), F.col("a_label").alias("label"), score.alias("score"))
        return pairs.orderBy(F.desc("score"), "obj_a_id", "obj_b_id").limit(per_bucket)

    found = materialise(best(_equal("label", "tokens")), "tricky-pairs")
    if found.where("score >= 2.5").count() < per_bucket:
        found = best(_equal("label"))
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "obj_a_id", "obj_b_id"))).select("obj_a_id", "obj_b_id", "label", "score", "rank")
