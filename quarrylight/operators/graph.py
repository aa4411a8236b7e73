"""The place-view-object graph as node and edge DataFrames, and its path queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles
from ..storage import materialise
from .ranks import numbered

# Each direction and its reverse; the names that a caller may use.
REVERSE = {"NORTH_OF": "SOUTH_OF", "SOUTH_OF": "NORTH_OF", "EAST_OF": "WEST_OF", "WEST_OF": "EAST_OF"}
DIRECTION_NAMES = {"north": "NORTH_OF", "south": "SOUTH_OF", "east": "EAST_OF", "west": "WEST_OF"}
#: Place tables up to this size are sent to every task for the nearest-neighbour join.
BROADCAST_PLACES = 5_000


def direction_name(direction: str) -> str:
    token = direction.strip().lower().removesuffix("_of")
    if token not in DIRECTION_NAMES:
        raise ValueError(f"no such direction: {direction}")
    return DIRECTION_NAMES[token]


def majority(df: DataFrame, keys: list[str], column: str, out: str, default: str = "unknown") -> DataFrame:
    """The most frequent value of each key, the smallest on ties; missing ones count as ``default``."""
    value = F.coalesce(F.when(F.trim(column) != "", F.col(column)), F.lit(default)).alias(out)
    counts = df.select(*keys, value).groupBy(*keys, out).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("_m"), out)).alias("_s")).select(*keys, F.col(f"_s.{out}").alias(out))


def places(views: DataFrame) -> DataFrame:
    """Views at one position, on a grid of 0.1 mm, are a place, numbered by its smallest view; with majority attributes."""
    spot = views.withColumns({"_kx": F.bround("x", 4), "_kz": F.bround("z", 4)})
    keys = ["_kx", "_kz"]
    groups = spot.groupBy(*keys).agg(
        F.min("id").alias("first_view"), F.min_by("x", "id").alias("x"), F.min_by("z", "id").alias("z"),
        F.count(F.lit(1)).alias("n_views"), F.array_sort(F.collect_set(F.pmod("orientation", F.lit(360)))).alias("scan_angles"),
    )
    for column in ("room_function", "view_type"):
        groups = groups.join(majority(spot, keys, column, column), keys)
    return numbered(groups, "first_view", "place_no").withColumn("place_id", F.format_string("place_%05d", "place_no")).drop(*keys, "place_no")


def views_of_places(views: DataFrame, place_table: DataFrame) -> DataFrame:
    """Views with the identifier of their place."""
    p = place_table.select("place_id", F.bround("x", 4).alias("_kx"), F.bround("z", 4).alias("_kz"))
    return views.withColumns({"_kx": F.bround("x", 4), "_kz": F.bround("z", 4)}).join(p, ["_kx", "_kz"]).drop("_kx", "_kz")


def _in_cells(a: DataFrame, b: DataFrame, side: float, reach: int) -> DataFrame:
    """Pairs of places whose cells are at most ``reach`` apart."""
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    around = a.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    around = around.withColumns({"_i": cell("a_x") + F.col("_i"), "_j": cell("a_z") + F.col("_j")})
    return around.join(b.withColumns({"_i": cell("b_x"), "_j": cell("b_z")}), ["_i", "_j"]).drop("_i", "_j")


def neighbour_pairs(place_table: DataFrame, k: int, radius: float | None, broadcast_places: int = BROADCAST_PLACES) -> DataFrame:
    """Each place's ``k`` nearest others, by distance and identifier.

    With a radius, places meet within grid cells of that size and their neighbours. Without, few places are sent to all
    tasks. Many meet in the cells around them, cells that hold about ``k`` places each, then twice and four times as far:
    a place is done when its k-th neighbour is nearer than what the cells leave out. The few that are far from all others
    then meet all places.
    """
    p = place_table.select("place_id", "x", "z")
    a, b = (p.select(*(F.col(c).alias(f"{s}_{c}") for c in p.columns)) for s in "ab")

    def ranked(pairs: DataFrame) -> DataFrame:
        dx, dz = F.col("b_x") - F.col("a_x"), F.col("b_z") - F.col("a_z")
        out = pairs.where("a_place_id <> b_place_id").select("a_place_id", "b_place_id", dx.alias("dx"), dz.alias("dz"), F.hypot(dx, dz).alias("distance"))
        out = out if radius is None else out.where(F.col("distance") <= radius)
        order = Window.partitionBy("a_place_id").orderBy("distance", "b_place_id")
        return out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)

    if radius is not None:
        return ranked(_in_cells(a, b, radius, 1)).drop("_r")
    whole = p.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1")).first()
    if whole["n"] <= broadcast_places:
        return ranked(a.crossJoin(F.broadcast(b))).drop("_r")
    side = max(1e-6, (max(whole["x1"] - whole["x0"], 1e-6) * max(whole["z1"] - whole["z0"], 1e-6) * k / whole["n"]) ** 0.5)
    done, waiting = None, a
    for reach in (1, 2, 4):
        near = materialise(ranked(_in_cells(waiting, b, side, reach)), "near-places")
        full = near.where(F.col("_r") == k).where(F.col("distance") <= reach * side).select("a_place_id")
        done = near.join(full, "a_place_id", "left_semi") if done is None else done.unionByName(near.join(full, "a_place_id", "left_semi"))
        waiting = materialise(waiting.join(full, "a_place_id", "left_anti"), "far-places")
    if waiting.isEmpty():
        return done.drop("_r")
    far = waiting.crossJoin(b) if waiting.count() > broadcast_places else b.crossJoin(F.broadcast(waiting))
    return done.unionByName(ranked(far)).drop("_r")


def direction_edges(place_table: DataFrame, k: int = 4, eps: float = 0.25, radius: float | None = None) -> DataFrame:
    """Edges to the nearest places by direction, and their reverses; of one (source, target, direction) there is one."""
    ahead = neighbour_pairs(place_table, k, radius).withColumn("direction", angles.cardinal_direction(F.col("dx"), F.col("dz"), eps)).where("direction is not null")
    back = F.create_map(*(F.lit(x) for pair in REVERSE.items() for x in pair))
    forward = ahead.select(F.col("a_place_id").alias("source"), F.col("b_place_id").alias("target"), "direction", "dx", "dz", "distance")
    reverse = ahead.select(F.col("b_place_id").alias("source"), F.col("a_place_id").alias("target"), F.element_at(back, F.col("direction")).alias("direction"), (-F.col("dx")).alias("dx"), (-F.col("dz")).alias("dz"), "distance")
    return forward.unionByName(reverse).dropDuplicates(["source", "target", "direction"])


def view_view_edges(views: DataFrame) -> DataFrame:
    """All ordered pairs of views of a place."""
    one = views.select("place_id", F.col("view_id").alias("source_view"))
    return one.join(views.select("place_id", F.col("view_id").alias("target_view")), "place_id").where("source_view <> target_view")


def place_object_edges(objects: DataFrame) -> DataFrame:
    return objects.select("place_id", F.format_string("obs_%06d", "object_global_id").alias("obs_id"), "object_global_id", "label", "view_id")


def summary(place_table: DataFrame, views: DataFrame, objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n) of the nodes and edges."""
    parts = {"places": place_table, "views": views, "objects": objects, "direction_edges": edges, "labels": objects.select("label").distinct()}
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, df in parts.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def top_labels(objects: DataFrame, limit: int = 10) -> DataFrame:
    return objects.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(limit)


def same_node(place_edges: DataFrame, views: DataFrame, place_id: str) -> DataFrame:
    """A place's views and objects: (kind, item)."""
    v = views.where(F.col("place_id") == place_id).select(F.lit("view").alias("kind"), F.col("view_id").alias("item"))
    return v.unionByName(place_edges.where(F.col("place_id") == place_id).select(F.lit("object").alias("kind"), F.col("obs_id").alias("item")))


def direction_neighbours(edges: DataFrame, place_table: DataFrame, place_id: str, direction: str) -> DataFrame:
    found = edges.where((F.col("source") == place_id) & (F.col("direction") == direction_name(direction)))
    return found.join(place_table.select(F.col("place_id").alias("target"), "room_function", "n_views"), "target").select("target", "direction", "distance", "room_function", "n_views")


def place_objects(place_edges: DataFrame, place_id: str, label: str | None = None) -> DataFrame:
    """A label filter here is case-sensitive."""
    found = place_edges.where(F.col("place_id") == place_id)
    return found if label is None else found.where(F.col("label") == label)


def places_for_object(place_edges: DataFrame, label: str) -> DataFrame:
    """Places with objects of a label, whatever its case, and in how many views."""
    if not label.strip():
        raise ValueError("a label is needed")
    found = place_edges.where(F.lower("label") == label.strip().lower())
    return found.groupBy("place_id").agg(F.count(F.lit(1)).alias("n_objects"), F.countDistinct("view_id").alias("n_views"))


def direction_objects(edges: DataFrame, place_edges: DataFrame, place_id: str, direction: str, label: str | None = None) -> DataFrame:
    """Objects of the places that lie in a direction of a place."""
    to = edges.where((F.col("source") == place_id) & (F.col("direction") == direction_name(direction))).select(F.col("target").alias("place_id"), "distance")
    found = to.join(place_edges, "place_id")
    return found if label is None else found.where(F.col("label") == label)


def context_strings(objects: DataFrame, edges: DataFrame, snippet: Column, same_limit: int = 8, direction_limit: int = 4) -> DataFrame:
    """One text per object: its place, other objects there, and objects of neighbouring places by direction."""
    rows = objects.select("object_global_id", "place_id", snippet.alias("snippet"))
    listed = lambda df, limit: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(df)), 1, limit), lambda s: s["snippet"]), "; ")
    other = rows.select("place_id", F.col("object_global_id").alias("other"), F.col("snippet"))
    ranked = other.withColumn("_r", F.row_number().over(Window.partitionBy("place_id").orderBy("other")))
    near = ranked.where(F.col("_r") <= same_limit + 1).select("place_id", "other", F.col("snippet"))
    same = rows.select("object_global_id", "place_id").join(near, "place_id").where("other <> object_global_id").groupBy("object_global_id").agg(listed(F.struct("other", "snippet"), same_limit).alias("same"))
    first = ranked.where(F.col("_r") <= direction_limit).select(F.col("place_id").alias("target"), "other", "snippet")
    around = edges.select("source", "direction", "target", "distance").join(first, "target").groupBy("source", "direction").agg(listed(F.struct("distance", "other", "snippet"), direction_limit).alias("text"))
    lines = around.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("direction", "text"))), lambda s: F.concat(F.lower(F.regexp_replace(s["direction"], "_OF", "")), F.lit(": "), s["text"])), " | ").alias("around"))
    out = rows.join(same, "object_global_id", "left").join(lines, rows["place_id"] == lines["source"], "left")
    return out.select("object_global_id", F.concat_ws(" | ", F.concat(F.lit("place="), "place_id"), "snippet", "same", "around").alias("context"))
