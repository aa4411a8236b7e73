"""Semantic rooms: places of one function and kind, their label statistics, and samples of their objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_objects(objects: DataFrame) -> DataFrame:
    """Objects with a label that says something, parsed or from an API; a table without ``parse_status`` is all parsed."""
    said = objects.where(~F.lower(F.trim(F.coalesce("label", F.lit("")))).isin("", "unknown", "none", "other"))
    return said.where(F.lower(F.trim(F.coalesce("parse_status", F.lit("unknown")))).isin("ok", "api")) if "parse_status" in objects.columns else said


def semantic_rooms(objects: DataFrame, places: DataFrame, least: int = 3) -> DataFrame:
    """One row per (function, kind) with at least ``least`` objects; numbers are given before small ones are left out."""
    rows = valid_objects(objects).join(places.select("place_id", "room_function", "view_type"), "place_id", "left").na.fill("unknown", ["room_function", "view_type"])
    key = ["room_function", "view_type"]
    labels = rows.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("n"))
    stats = labels.groupBy(*key).agg(
        F.sum("n").alias("num_objects"), F.count(F.lit(1)).alias("num_unique_labels"), F.max("n").alias("max_label_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.concat_ws("=", "label", F.col("n").cast("string"))))), ",").alias("repeated_labels"),
    )
    where = rows.groupBy(*key).agg(F.array_sort(F.collect_set("place_id")).alias("place_ids"))
    numbered = stats.join(where, key).withColumn("room_id", F.format_string("room_%03d", F.row_number().over(Window.orderBy(*key)) - 1))
    return numbered.withColumns({"duplicate_objects": F.col("num_objects") - F.col("num_unique_labels"), "unique_label_ratio": F.col("num_unique_labels") / F.col("num_objects")}).where(F.col("num_objects") >= least)


def select_rooms(rooms: DataFrame) -> DataFrame:
    """The simplest room, with the most different labels, and the most complex other one, with the most repeats."""
    simple = rooms.orderBy(F.desc("unique_label_ratio"), "duplicate_objects", F.desc("num_unique_labels"), "room_function", "view_type", "room_id").limit(1)
    others = rooms.join(simple.select("room_id"), "room_id", "left_anti").where("duplicate_objects > 0")
    complex_ = others.orderBy(F.desc("duplicate_objects"), F.desc("max_label_count"), F.desc("num_objects"), "room_function", "view_type", "room_id").limit(1)
    return simple.withColumn("kind", F.lit("simple")).unionByName(complex_.withColumn("kind", F.lit("complex")))


def sample_objects(objects: DataFrame, kind: str, most: int = 8) -> DataFrame:
    """Of each room (``room_id``): for "simple", lone labels and then one of each repeated label; for "complex", two of
    each repeated label, the most repeated first, then lone labels, then the rest; ``most`` at most."""
    if kind not in ("simple", "complex"):
        raise ValueError(f"no such kind: {kind}")
    by = Window.partitionBy("room_id", "label")
    rows = valid_objects(objects).withColumns({"_n": F.count(F.lit(1)).over(by), "_k": F.row_number().over(by.orderBy("entry_id", "object_global_id"))})
    if kind == "simple":
        turn = F.when(F.col("_n") == 1, 0).otherwise(1)
        rows = rows.where("_k = 1")
    else:
        turn = F.when((F.col("_n") > 1) & (F.col("_k") <= 2), 0).when(F.col("_n") == 1, 1).otherwise(2)
    rank = F.when(F.lit(kind == "complex") & (F.col("_n") > 1), -F.col("_n")).otherwise(0)
    order = Window.partitionBy("room_id").orderBy(turn, rank, "label", "_k")
    return rows.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= most).drop("_n", "_k")


def pair_extremes(pairs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of each key: the most and least similar pair, and mean similarity within and across labels."""
    v = F.round(F.col(value), 9)
    return pairs.groupBy(*keys).agg(
        F.min_by(F.struct("i", "j", F.col(value).alias("v")), F.struct(-v, "i", "j")).alias("hi"), F.min_by(F.struct("i", "j", F.col(value).alias("v")), F.struct(v, "i", "j")).alias("lo"),
        F.avg(F.when(F.col("i_label") == F.col("j_label"), F.col(value))).alias("mean_same_label"), F.avg(F.when(F.col("i_label") != F.col("j_label"), F.col(value))).alias("mean_other_label"),
    ).select(*keys, F.col("hi.i").alias("hi_i"), F.col("hi.j").alias("hi_j"), F.col("hi.v").alias("hi"), F.col("lo.i").alias("lo_i"), F.col("lo.j").alias("lo_j"), F.col("lo.v").alias("lo"), "mean_same_label", "mean_other_label")
