"""Spatial relations between views and objects, and between the objects of a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import angles
from ..functions.texts import MAX_SURROUNDINGS, location_summary

EXCLUDED = ("", "unknown", "other", "none")


def view_object(views: DataFrame, objects: DataFrame, camera_y: float = 0.0) -> DataFrame:
    """Offsets and distances from each view to its objects; objects without a view or a position are left out."""
    o = objects.select("object_global_id", "entry_id", "label", "gx", "gy", "gz")
    v = views.select(F.col("id").alias("entry_id"), "view_id", "orientation", "x", "z")
    dx, dy, dz = F.col("gx") - F.col("x"), F.col("gy") - camera_y, F.col("gz") - F.col("z")
    return o.join(v, "entry_id").where("gx is not null and gz is not null").select(
        "view_id", "object_global_id", dx.alias("dx"), dy.alias("dy"), dz.alias("dz"), F.hypot(dx, dz).alias("distance_2d"),
        F.sqrt(dx * dx + dz * dz + dy * dy).alias("distance_3d"), angles.vertical_direction(dy).alias("vertical"),
        angles.view_direction(dx, dz, F.col("orientation")).alias("direction"),
    )


def _pairs(objects: DataFrame, columns: list[str], condition: Column) -> DataFrame:
    """Ordered pairs of different objects of a view, as a self-join on the view."""
    side = lambda p: objects.select("entry_id", *(F.col(c).alias(f"{p}_{c}") for c in columns))
    return side("a").join(side("b"), "entry_id").where(condition)


def object_object(objects: DataFrame, eps: float = 0.25) -> DataFrame:
    """Of each ordered pair in a view, where the second lies as the camera sees it; pairs too near to tell are left out."""
    placed = objects.where("gx is not null and gz is not null")
    pairs = _pairs(placed, ["object_global_id", "gx", "gy", "gz", "orientation"], F.col("a_object_global_id") != F.col("b_object_global_id"))
    dx, dy, dz = (F.col(f"b_{c}") - F.col(f"a_{c}") for c in ("gx", "gy", "gz"))
    return pairs.select(
        "entry_id", F.col("a_object_global_id").alias("source_id"), F.col("b_object_global_id").alias("target_id"),
        angles.view_direction(dx, dz, F.col("a_orientation"), eps).alias("direction"), angles.vertical_direction(dy).alias("vertical"),
        F.hypot(dx, dz).alias("distance_2d"), F.sqrt(dx * dx + dz * dz + dy * dy).alias("distance_3d"),
    ).where("direction is not null")


def polar_relations(objects: DataFrame, radius: float = 2.0) -> DataFrame:
    """Ordered pairs of a view nearer than ``radius`` by range and bearing, with the local phrase and compass direction."""
    seen = objects.where(~F.lower(F.trim("label")).isin(*EXCLUDED) & F.col("distance_m").isNotNull() & F.col("bearing_deg").isNotNull())
    columns = ["object_global_id", "label", "distance_m", "bearing_deg", "height_m", "gx", "gy", "gz", "orientation"]
    pairs = _pairs(seen, columns, F.col("a_object_global_id") != F.col("b_object_global_id"))
    turn = angles.wrapped_delta(F.col("b_bearing_deg") - F.col("a_bearing_deg"))
    rows = pairs.withColumn("delta_angle_deg", turn).withColumn("distance", angles.polar_distance(F.col("a_distance_m"), F.col("b_distance_m"), F.col("delta_angle_deg"))).where(F.col("distance") < radius)
    depth, height = F.col("b_distance_m") - F.col("a_distance_m"), F.col("b_height_m") - F.col("a_height_m")
    bearing = F.coalesce(angles.bearing_between(F.col("a_gx"), F.col("a_gz"), F.col("b_gx"), F.col("b_gz")), angles.camera_bearing(F.col("a_orientation"), F.col("b_bearing_deg")))
    return rows.select(
        "entry_id", F.col("a_object_global_id").alias("source_id"), F.col("b_object_global_id").alias("target_id"), F.col("b_label").alias("target_label"),
        "distance", "delta_angle_deg", depth.alias("delta_depth_m"), height.alias("delta_height_m"),
        angles.local_phrase(F.col("delta_angle_deg"), depth, height).alias("phrase"), bearing.alias("bearing"), angles.compass8(bearing).alias("direction8"),
    )


def polar_surroundings(objects: DataFrame, relations: DataFrame, limit: int = MAX_SURROUNDINGS) -> DataFrame:
    """Each object's nearest surroundings as an ordered array and as a summary; objects without any stay."""
    context = relations.groupBy(F.col("source_id").alias("object_global_id")).agg(
        F.slice(F.array_sort(F.collect_list(F.struct(
            F.col("distance").alias("distance_from_primary_m"), F.col("target_id"), F.col("target_label").alias("label"),
            F.col("phrase").alias("semantic_relation_local"), F.col("direction8").alias("allocentric_direction_8"),
        ))), 1, limit).alias("surroundings")
    )
    out = objects.select("object_global_id").join(context, "object_global_id", "left")
    return out.withColumn("n", F.coalesce(F.size(F.col("surroundings")), F.lit(0))).withColumn("summary", F.when(F.col("surroundings").isNull(), "").otherwise(location_summary(F.col("surroundings"))))
