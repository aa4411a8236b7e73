"""Instances: what a clustering says about objects, groups of chosen views, scored ground truth, growing summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot, l2_normalised
from . import clustering, similarity
from .rooms import valid_objects

#: What a missing identifier counts as in orders: last.
NO_ID = 10**9
SCOPES = {"place": ["place_id"], "place_label": ["place_id", "label"], "label": ["label"], "all": []}


def sequence_objects(objects: DataFrame) -> DataFrame:
    """Objects with a label that says something and an identifier that is not negative."""
    return objects.where(~F.lower(F.trim(F.coalesce("label", F.lit("")))).isin("", "unknown", "other", "none") & (F.col("object_global_id") >= 0))


def ordered_views(objects: DataFrame, view_ids: list[str]) -> DataFrame:
    """Valid objects of the views, with the view's place in the given order and the object's in its view."""
    listed = objects.sparkSession.createDataFrame([(v, i) for i, v in reversed(list(enumerate(view_ids)))], "view_id string, step int").groupBy("view_id").agg(F.min("step").alias("step"))
    rows = sequence_objects(objects).join(F.broadcast(listed), "view_id")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("view_id").orderBy("object_global_id")) - 1)


def observation_order(entry: str = "entry_id") -> list[Column]:
    missing_last = lambda c: F.coalesce(F.col(c), F.lit(NO_ID))
    return [missing_last("object_global_id"), F.coalesce("view_id", F.lit("")), missing_last(entry)]


def scoped(objects: DataFrame, scope: str) -> DataFrame:
    """Adds ``group_id`` by the scope of a clustering: objects of one place, of one label, of both, or all."""
    if scope not in SCOPES:
        raise ValueError(f"no such scope: {scope}")
    return objects.withColumn("group_id", F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in SCOPES[scope])) if SCOPES[scope] else F.lit("all"))


def batch_dedup(objects: DataFrame, group: str, penalty: float = 0.8, least: float = 0.60, clusters: int | None = None) -> DataFrame:
    """(group, object_global_id, cluster, reason, position, block_end): one entity for each cluster of observations.

    Cosines, the multi-view affinity, spectral clusters of each group and the order of their display.
    """
    if not objects.where("vec is null").isEmpty():
        raise ValueError("an object has no vector")
    affinity = similarity.multi_view(similarity.text_similarity(objects, group), penalty, least)
    labels = clustering.spectral_clusters(objects, affinity, group, clusters=clusters)
    return clustering.block_order(labels, group)


def average_cluster_size(labels: DataFrame, group: str) -> DataFrame:
    sizes = labels.groupBy(group, "cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(group).agg(F.avg("n").alias("average_size"), F.count(F.lit(1)).alias("n_clusters"))


def candidate_id(kind: str, group: Column, cluster: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), group.cast("string"), F.lit(":cluster_"), F.format_string("%03d", cluster))


def instance_candidates(labels: DataFrame, objects: DataFrame, sims: DataFrame, group: str, kind: str = "place") -> tuple[DataFrame, DataFrame]:
    """Candidates, one for each cluster, and the edges of their members.

    A candidate has its size, members, views, labels, whether two members come from one view, and its medoid's label.
    """
    whole = clustering.summaries(labels, objects, group)
    best = clustering.medoids(labels, sims, group).select(group, "cluster", F.col("medoid").alias("representative_object_id"))
    texts = objects.select(F.col("object_global_id").alias("representative_object_id"), F.col("label").alias("representative_label"), F.col("description").alias("representative_description"))
    ident = candidate_id(kind, F.col(group), F.col("cluster"))
    nodes = whole.join(best, [group, "cluster"]).join(texts, "representative_object_id", "left").withColumn("candidate_instance_id", ident)
    edges = labels.select(group, "cluster", "object_global_id").join(objects.select("object_global_id", "view_id"), "object_global_id")
    return nodes, edges.select(ident.alias("candidate_instance_id"), "object_global_id", "view_id", group)


def label_payload(labels: DataFrame, objects: DataFrame, group: str) -> DataFrame:
    """One row for each object of a clustering with what a reader of labels needs; missing values have their defaults."""
    text = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d)).alias(c)
    rows = labels.select(group, "cluster", "object_global_id").join(objects.select("object_global_id", "view_id", "entry_id", "label", "description"), "object_global_id")
    return rows.select(group, "cluster", "object_global_id", text("view_id"), F.coalesce("entry_id", F.lit(-1)).alias("entry_id"), text("label", "unknown"), text("description"))


def without_vectors(objects: DataFrame, vector: str = "vec") -> DataFrame:
    """Rows for export: the vector's place is taken by whether there is one, and its dimension."""
    return objects.withColumns({"embedding_available": F.col(vector).isNotNull(), "embedding_dim": F.coalesce(F.when(F.col(vector).isNotNull(), F.size(vector)), F.lit(0))}).drop(vector)


def member_object_id(member: Column) -> Column:
    """The number in a member's name, "label (7)"; null if there is none."""
    return F.when(member.rlike("\\((\\d+)\\)\\s*$"), F.regexp_extract(member, "\\((\\d+)\\)\\s*$", 1).cast("long"))


def selected_view_group(objects: DataFrame, view_ids: list[str], least: int = 3) -> tuple[DataFrame, DataFrame]:
    """The chosen views as one room (a row of statistics), and their valid objects in the order of the views.

    The most frequent function and kind count, apart from unknown ones; of equally frequent the first seen.
    """
    views = [v for v in view_ids if v and v.strip()]
    if not views:
        raise ValueError("at least one view is needed")
    listed = objects.sparkSession.createDataFrame([(v, i) for i, v in enumerate(dict.fromkeys(views))], "view_id string, view_rank int")
    rows = valid_objects(objects).join(F.broadcast(listed), "view_id")
    order = Window.orderBy("view_rank", "label", "object_global_id")
    rows = rows.withColumn("position", F.row_number().over(order) - 1)
    labels = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    stats = labels.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_objects"), F.count(F.lit(1)).alias("num_unique_labels"), F.coalesce(F.max("n"), F.lit(0)).alias("max_label_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.concat_ws("=", "label", F.col("n").cast("string"))))), ",").alias("repeated_labels"),
    )
    if stats.first()["num_objects"] < least:
        raise ValueError(f"the views have fewer than {least} valid objects")

    def mode(column: str) -> DataFrame:
        counts = rows.where(F.col(column).isNotNull() & ~F.trim(column).isin("", "unknown")).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))
        return counts.agg(F.coalesce(F.max_by(column, F.struct("n", -F.col("first"))), F.lit("selected_views")).alias(column))

    members = rows.agg(F.array_sort(F.collect_set("place_id")).alias("place_ids"), F.array_sort(F.collect_list("object_global_id")).alias("object_ids"))
    room = stats.crossJoin(mode("room_function")).crossJoin(mode("view_type")).crossJoin(members)  # one row each
    return room.withColumns({"room_id": F.lit("selected_views"), "duplicate_objects": F.col("num_objects") - F.col("num_unique_labels"), "unique_label_ratio": F.col("num_unique_labels") / F.col("num_objects")}), rows


def pair_scores(pairs: DataFrame, vectors: dict[str, DataFrame], a: str = "obj_a_id", b: str = "obj_b_id") -> DataFrame:
    """Cosines of ground-truth pairs, a column ``<name>_cosine`` for each representation (row_idx, vec).

    A pair that names an object which a representation does not have raises.
    """
    out = pairs
    for name, table in vectors.items():
        unit = table.select(F.col("row_idx"), l2_normalised(F.col("vec")).alias("_u"))
        lost = pairs.select(F.explode(F.array(a, b)).alias("row_idx")).join(unit, "row_idx", "left_anti")
        if (first := lost.agg(F.min("row_idx").alias("m")).first()["m"]) is not None:
            raise KeyError(f"object {first} is outside the {name} vectors")
        one, two = (unit.select(F.col("row_idx").alias(c), F.col("_u").alias(f"_{s}")) for c, s in ((a, "ua"), (b, "ub")))
        out = out.join(one, a).join(two, b).withColumn(f"{name}_cosine", dot(F.col("_ua"), F.col("_ub"))).drop("_ua", "_ub")
    return out


def step_summaries(changes: DataFrame) -> DataFrame:
    """Counts of each kind of change in each step of an incremental run (scene, step, case, cluster_id, object_global_id)."""
    kind = lambda *names: F.sum(F.col("case").isin(*names).cast("long"))
    return changes.groupBy("scene", "step").agg(
        F.countDistinct(F.when(~F.col("case").isin("merge"), F.col("object_global_id"))).alias("n_objects"), kind("append").alias("n_appended"), kind("merge").alias("n_merged"),
        kind("new").alias("n_new"), kind("late").alias("n_late"), F.countDistinct("cluster_id").alias("n_clusters"),
    )


def cluster_outputs(members: DataFrame, keys: list[str]) -> DataFrame:
    """Each cluster with its members' names, views and the counts of its labels, for reports."""
    name = F.concat(F.coalesce("label", F.lit("unknown")), F.lit(" ("), F.col("object_global_id").cast("string"), F.lit(")"))
    counts = members.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_histogram"),
        F.max_by("label", F.struct("n", "label")).alias("dominant_label"), (F.max("n") / F.sum("n")).alias("dominant_share"),
    )
    listed = members.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("object_global_id", name.alias("name")))), lambda m: m["name"]).alias("members"),
        F.array_sort(F.collect_set("view_id")).alias("member_view_ids"),
    )
    return listed.join(counts, keys)


def retrieved(hits: DataFrame, least: float = 0.25) -> DataFrame:
    """The best candidate of each query, and none if it scores less than ``least``."""
    best = hits.groupBy("query_id").agg(F.max_by(F.struct("id", "score"), F.struct(F.col("score"), -F.col("id"))).alias("b"))
    sure = F.col("b.score") >= least
    return best.select("query_id", F.when(sure, F.col("b.id")).alias("id"), F.col("b.score").alias("score"), (~sure).alias("is_none"))
