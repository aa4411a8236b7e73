"""Records of objects: merging sources, filling gaps, choosing examples, grouping what is the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles
from ..functions.texts import usable
from .components import connected_components
from .ranks import numbered


def merged(raw: DataFrame, payload: DataFrame, key: str, null_wins: bool = True) -> DataFrame:
    """Raw rows with the payload's values over theirs. A payload's null hides the raw value, unless ``null_wins`` is off."""
    marked = payload.select(F.col(key), F.lit(True).alias("_has"), *(F.col(c).alias(f"_p_{c}") for c in payload.columns if c != key))
    rows = raw.join(marked, key, "left")
    shared = set(payload.columns) - {key}
    there = F.coalesce("_has", F.lit(False))
    value = lambda c: (F.when(there, F.col(f"_p_{c}")).otherwise(F.col(c)) if null_wins else F.coalesce(f"_p_{c}", c)).alias(c) if c in shared else F.col(c)
    return rows.select(*(value(c) for c in raw.columns), *(F.col(f"_p_{c}").alias(c) for c in payload.columns if c in shared - set(raw.columns)))


def located(objects: DataFrame) -> DataFrame:
    """Adds ``px`` and ``pz``: the given position, or the projection from the camera if either coordinate is missing."""
    x, z = angles.project_from_camera(F.col("x"), F.col("z"), F.col("orientation"), F.col("bearing_deg"), F.col("distance_m"))
    given = F.col("gx").isNotNull() & F.col("gz").isNotNull()
    return objects.withColumns({"px": F.when(given, F.col("gx")).otherwise(x), "pz": F.when(given, F.col("gz")).otherwise(z)})


def with_vectors(rows: DataFrame, known: DataFrame, key: str, text: str, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows with their known vector, else one made from their text by the hook; rows without usable text or vector go."""
    joined = rows.join(known.select(key, F.col("vec").alias("_known")), key, "left")
    made = F.when(usable(F.col(text)), embed(F.col(text))) if embed else F.lit(None)
    return joined.withColumn("vec", F.coalesce("_known", made)).drop("_known").where(F.col("vec").isNotNull() & usable(F.col(text)))


def example_buckets(scored: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n highest and lowest scores of each class: easy and hard examples."""
    by = Window.partitionBy(*keys, "label")
    up, down = (F.row_number().over(by.orderBy(o, "a", "b")) for o in (F.asc("score"), F.desc("score")))
    ranked = scored.withColumns({"_up": up, "_down": down})
    kinds = F.array(F.when(F.col("_down") <= n, F.struct(F.lit("highest").alias("end"), F.col("_down").alias("rank"))), F.when(F.col("_up") <= n, F.struct(F.lit("lowest").alias("end"), F.col("_up").alias("rank"))))
    out = ranked.where((F.col("_up") <= n) | (F.col("_down") <= n)).withColumn("k", F.explode(F.array_compact(kinds)))
    return out.select(*keys, "label", "k.end", "k.rank", "a", "b", "score")


def drawn(df: DataFrame, keys: list[str], id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each key by a digest of the id: a reproducible draw that no partitioning changes."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def far_from(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Points with none of ``others`` nearer than ``radius``; candidates meet in grid cells of that size."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    cell = lambda c: F.floor(F.col(c) / radius)
    keyed = points.withColumns({"_i": cell("x"), "_j": cell("z")})
    dealt = others.select(F.col("x").alias("_ox"), F.col("z").alias("_oz"), cell("x").alias("_a"), cell("z").alias("_b"))
    dealt = dealt.withColumn("_da", F.explode(near)).withColumn("_db", F.explode(near)).select("_ox", "_oz", (F.col("_a") + F.col("_da")).alias("_ci"), (F.col("_b") + F.col("_db")).alias("_cj"))
    meets = (F.col("_i") == F.col("_ci")) & (F.col("_j") == F.col("_cj")) & (F.hypot(F.col("x") - F.col("_ox"), F.col("z") - F.col("_oz")) < radius)
    return keyed.join(dealt, meets, "left_anti").drop("_i", "_j")


def spaced(points: DataFrame, key: str, radius: float) -> DataFrame:
    """Points (key, x, z) taken in the order of ``key``, each unless a taken one is nearer than ``radius``.

    In rounds: a point without an open smaller neighbour is taken, and what is near it goes. Pairs meet in grid cells.
    """
    reach = F.array(F.lit(-1), F.lit(0), F.lit(1))
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    own = points.select(F.col(key).alias("a"), F.col("x").alias("ax"), F.col("z").alias("az"), cell("x").alias("i"), cell("z").alias("j"))
    dealt = points.select(F.col(key).alias("b"), F.col("x").alias("bx"), F.col("z").alias("bz"), cell("x").alias("_i"), cell("z").alias("_j")).withColumn("_di", F.explode(reach)).withColumn("_dj", F.explode(reach))
    dealt = dealt.select("b", "bx", "bz", (F.col("_i") + F.col("_di")).alias("i"), (F.col("_j") + F.col("_dj")).alias("j"))
    keep = (lambda d: d.checkpoint()) if points.sparkSession.sparkContext.getCheckpointDir() else (lambda d: d)
    near = keep(own.join(dealt, ["i", "j"]).where((F.col("b") < F.col("a")) & (F.hypot(F.col("ax") - F.col("bx"), F.col("az") - F.col("bz")) < radius)).select("a", "b"))
    waiting, taken = points.select(F.col(key).alias("a")), None
    while not waiting.isEmpty():
        ready = keep(waiting.join(near.select("a").distinct(), "a", "left_anti"))
        taken = ready if taken is None else taken.unionByName(ready)
        gone = near.join(ready.select(F.col("a").alias("b")), "b", "left_semi").select("a").distinct()
        waiting = keep(waiting.join(ready, "a", "left_anti").join(gone, "a", "left_anti"))
        near = keep(near.join(waiting, "a", "left_semi").join(waiting.select(F.col("a").alias("b")), "b", "left_semi"))
    return points.join(taken.select(F.col("a").alias(key)), key, "left_semi") if taken is not None else points


def same_object_groups(pairs: DataFrame) -> DataFrame:
    """(group_no, object_id, size) of objects joined by positive pairs (a, b, label), numbered by their smallest object."""
    c = connected_components(pairs.where("label = 1"), "a", "b")
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return c.join(numbered(sizes, "component", "group_no"), "component").select("group_no", F.col("node").alias("object_id"), "size")


def best_of_entity(hits: DataFrame, entity: list[str], least: float, k: int) -> DataFrame:
    """Cosine retrieval: the best hit of each entity, those of at least ``least``, the first k of each query."""
    best = hits.groupBy("query_id", *entity).agg(F.max("score").alias("score")).where(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *entity)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def size_histogram(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """(size, n) of clusters."""
    return clusters.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def label_jitter(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters whose members do not agree on a label."""
    return clusters.groupBy(*keys).agg(F.countDistinct("label").alias("n_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels")).where("n_labels > 1")


def file_names(docs: DataFrame, key: str, document: str, name: str = "file_name") -> DataFrame:
    """(key, value): the distinct texts under ``name``, however deep in a JSON text; one pass for each level of nesting."""
    spark = docs.sparkSession
    level = docs.select(key, F.try_parse_json(document).alias("_v")).where("_v is not null")
    found = None
    while True:
        parts = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(F.col(key), F.col("key").alias("_k"), F.col("value").alias("_v"))
        hit = parts.where((F.col("_k") == name) & F.schema_of_variant("_v").startswith("STRING")).select(key, F.variant_get("_v", "$", "string").alias("value"))
        found = hit if found is None else found.unionByName(hit)
        level = parts.where(F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)")).select(key, "_v")
        if level.isEmpty():
            return found.distinct()


def view_attributes(scene: Column) -> Column:
    """The view's attribute struct with a default for each part."""
    text = lambda n, d="unknown": F.coalesce(F.when(F.trim(scene[n]) != "", F.trim(scene[n])), F.lit(d)).alias(n)
    kinds = ("view_type", "room_function", "style_hint", "clutter_level", "floor_pattern", "lighting_ceiling", "wall_color")
    return F.struct(*(text(k) for k in kinds), F.coalesce(scene["scene_attributes"], F.array().cast("array<string>")).alias("scene_attributes"), text("additional_notes", ""), text("image_summary", ""))
