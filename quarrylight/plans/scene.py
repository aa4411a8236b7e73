"""Whole-scene plans: derived tables of a scene database, checks of its graph, and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles, texts
from ..operators import graph, relations, rooms, similarity


@dataclass
class SceneTables:
    """Lazy tables; a sink or a query decides what is computed."""

    views: DataFrame
    objects: DataFrame
    places: DataFrame
    view_edges: DataFrame
    object_edges: DataFrame
    place_edges: DataFrame
    direction_edges: DataFrame
    polar: DataFrame | None

    def write(self, path: str) -> None:
        """Each table as Parquet, overwritten as a whole, so that a repeated build gives the same files."""
        for name, df in vars(self).items():
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")


def build(views: DataFrame, objects: DataFrame, k: int = 4, radius: float | None = None, with_polar: bool = False) -> SceneTables:
    """From views and observations everything that is derived: places, relations, edges."""
    p = graph.places(views)
    return SceneTables(
        graph.views_of_places(views, p), objects, p, relations.view_object(views, objects), relations.object_object(objects),
        graph.place_object_edges(objects), graph.direction_edges(p, k, radius=radius), relations.polar_relations(objects) if with_polar else None,
    )


def oriented(objects: DataFrame, step: float, split: bool) -> DataFrame:
    """Object orientations of the two builds: that of the frame, or offset by laterality; with the prefix of long texts."""
    turned = angles.object_orientation(F.col("orientation"), F.col("laterality"), step) if split else angles.wrap360(F.col("orientation").cast("double"))
    bucket = F.when(F.lit(split), F.col("laterality")).otherwise("frame")
    return objects.withColumns({"object_orientation_deg": turned, "angle_bucket": bucket, "text_long": F.concat(F.lit("["), bucket, F.lit("] "), texts.safe_text(F.col("description"), "unknown"))})


def graph_checks(t: SceneTables, place_id: str | None = None, label: str | None = None) -> DataFrame:
    """(check, status, n): passed, failed or skipped, for the counts and each of the path queries.

    Without a place the path queries are skipped; the place is the given one or the first with views, the label the given
    one or the most frequent; the directional query takes the first of north, east, south, west that has objects.
    """
    spark = t.views.sparkSession
    anchor = place_id or (first["place_id"] if (first := t.places.where("n_views > 0").orderBy("place_id").first()) else None)
    top = graph.top_labels(t.place_edges, 1).first()
    named = label or (top["label"] if top else None)
    rows: list[tuple[str, str, int]] = []

    def check(name: str, df: DataFrame | None) -> None:
        n = df.count() if df is not None else 0
        rows.append((name, "skipped" if df is None else "passed" if n else "failed", n))

    check("places", t.places)
    check("views", t.views)
    check("objects", t.place_edges)
    check("same_node", graph.same_node(t.place_edges, t.views, anchor) if anchor else None)
    check("place_objects", graph.place_objects(t.place_edges, anchor) if anchor else None)
    check("places_for_object", graph.places_for_object(t.place_edges, named) if named else None)
    found = None
    for direction in ("north", "east", "south", "west") if anchor else ():
        found = graph.direction_objects(t.direction_edges, t.place_edges, anchor, direction)
        if not found.isEmpty():
            break
    check("direction_objects", found)
    return spark.createDataFrame(rows, "check string, status string, n long")


def analyse_rooms(t: SceneTables, least: int = 3, most: int = 8) -> dict[str, DataFrame]:
    """Rooms, the simple and the complex one, samples of their objects, and all pairs of each sample with every score."""
    found = rooms.semantic_rooms(t.objects, t.places, least)
    chosen = rooms.select_rooms(found)
    member = chosen.select("room_id", "kind", F.explode("place_ids").alias("place_id"))
    objects = t.objects.join(member, "place_id")
    sample = rooms.sample_objects(objects.where("kind = 'simple'"), "simple", most).unionByName(rooms.sample_objects(objects.where("kind = 'complex'"), "complex", most))
    sims = similarity.text_similarity(sample, "room_id", ("view_id", "label"))
    fused = similarity.fused(sims, similarity.geometry(sample, "room_id"), "room_id")
    return {"rooms": found, "chosen": chosen, "sample": sample, "pairs": fused, "extremes": rooms.pair_extremes(fused, ["room_id"], "fused_after")}


def valid_poses(poses: DataFrame, most_snap: float = 0.75, least_apart: float = 0.1) -> DataFrame:
    """(anchor_id, problem) for each anchor: null, or why its poses cannot be used.

    Poses (anchor_id, side, x, z, snap_m): four are needed, none moved far to reach the floor, no two nearly the same.
    """
    stats = poses.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"), F.max("snap_m").alias("snap"))
    a, b = (poses.select("anchor_id", F.col("side").alias(f"{s}_side"), F.col("x").alias(f"{s}_x"), F.col("z").alias(f"{s}_z")) for s in "ab")
    near = a.join(b, "anchor_id").where("a_side < b_side").groupBy("anchor_id").agg(F.min(F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_z") - F.col("b_z"))).alias("apart"))
    problem = F.when(F.col("n") != 4, "wrong number of poses").when(F.col("snap") > most_snap, "moved too far").when(F.col("apart") < least_apart, "poses too close")
    return stats.join(near, "anchor_id", "left").select("anchor_id", problem.alias("problem"))


def snapshots(changes: DataFrame) -> DataFrame:
    """Membership after each step from a stream of changes (scene, step, case, cluster_id, object_global_id).

    A merge names the cluster that stays and the one that went; members follow it, also through later merges.
    """
    joined = changes.where("case not in ('merge', 'late')").select("scene", F.col("step").alias("joined"), "object_global_id", F.col("cluster_id").alias("first_cluster"))
    steps = changes.select("scene", "step").distinct()
    merges = changes.where("case = 'merge'").select("scene", F.col("step").alias("merged"), F.col("object_global_id").alias("gone"), F.col("cluster_id").alias("into"))
    rows = joined.join(steps, "scene").where("joined <= step").withColumn("cluster_id", F.col("first_cluster"))
    while True:
        moved = rows.join(merges, (rows["scene"] == merges["scene"]) & (rows["cluster_id"] == merges["gone"]) & (merges["merged"] <= rows["step"]) & (merges["merged"] >= rows["joined"]), "left")
        following = moved.select(rows["scene"], "joined", "object_global_id", "first_cluster", "step", F.coalesce("into", "cluster_id").alias("cluster_id"), F.col("into").isNotNull().alias("_moved"))
        if following.where("_moved").isEmpty():
            return rows.select("scene", "step", "cluster_id", "object_global_id", "joined").withColumn("order", F.row_number().over(Window.partitionBy("scene", "step").orderBy("cluster_id", "joined", "object_global_id")))
        rows = following.drop("_moved")


def build_report(views: DataFrame, objects: DataFrame) -> DataFrame:
    """Counters of a build: views and objects by parse status, objects with a position, mean objects per view."""
    v = views.agg(F.count(F.lit(1)).alias("views"))
    o = objects.agg(F.count(F.lit(1)).alias("objects"), F.sum(F.col("gx").isNotNull().cast("long")).alias("located"), F.countDistinct("label").alias("labels"), F.countDistinct("entry_id").alias("views_with_objects"))
    return v.crossJoin(o).withColumn("objects_per_view", F.col("objects") / F.col("views"))


