"""Exact vector search, fused scores, ranking by entity and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot
from . import products

#: A set of queries up to this size is sent to every task; larger ones meet the rows in blocks.
BROADCAST_QUERIES = 2_000
BLOCK = 2_000
#: Rows are dealt to so many tasks for each block.
DEALS = 64


def meet(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Every query with every row: queries by broadcast while they are few (checked), else in blocks by an equi-join."""
    n = queries.count()
    if n <= BROADCAST_QUERIES:
        return rows.crossJoin(F.broadcast(queries))
    blocks = -(-n // BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    placed = queries.withColumn("_block", F.pmod(F.xxhash64(*queries.columns[:1]), F.lit(blocks))).withColumn("_deal", every(DEALS))
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(DEALS))).withColumn("_block", every(blocks))
    return dealt.join(placed, ["_block", "_deal"]).drop("_block", "_deal")


def scores(queries: DataFrame, rows: DataFrame, query_vec: str = "query_vec", vec: str = "vec") -> DataFrame:
    """Inner products; both sides' other columns stay."""
    return meet(queries, rows).withColumn("score", dot(F.col(query_vec), F.col(vec))).drop(query_vec, vec)


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` of each key; Spark prunes to k per task before its shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, k: int) -> DataFrame:
    """The ``k`` nearest rows of each query with their score and rank; rows have identifiers of their own."""
    found = top(products.nearest_rows(queries, rows, id_col, k), ["query_id"], [F.desc("score"), F.asc(id_col)], k)
    return found.join(rows.drop("vec"), id_col) if set(rows.columns) - {id_col, "vec"} else found


def fused(image: Column, text: Column, w_image: float = 0.5, w_text: float = 0.5) -> Column:
    """Weighted sum of two scores, weights over their total."""
    total = w_image + w_text
    if total <= 0:
        raise ValueError("weights must not be zero together")
    return image * (w_image / total) + text * (w_text / total)


def entry_scores(queries: DataFrame, rows: DataFrame, id_col: str, entries: DataFrame | None = None) -> DataFrame:
    """(query_id, entry_id, score): the best hit of each entry, at least 0; entries without a row get 0."""
    best = products.best_in_groups(queries, rows, "entry_id", id_col).select("query_id", "entry_id", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("score"))
    if entries is None:
        return best
    empty = entries.select("entry_id").distinct().join(rows.select("entry_id").distinct(), "entry_id", "left_anti")
    return best.unionByName(meet(queries.select(F.col("query_id").cast("long")), empty.select(F.col("entry_id").cast("long"))).select("query_id", "entry_id", F.lit(0.0).alias("score")))


def best_match(queries: DataFrame, rows: DataFrame, id_col: str, digits: int | None = None) -> DataFrame:
    """(query_id, entry_id, id_col, score): each entry's hit with the highest rounded score, the smallest id on ties."""
    return products.best_in_groups(queries, rows, "entry_id", id_col, digits).where("score > -1")


def best_entries(queries: DataFrame, rows: DataFrame, views: DataFrame, top_k: int, digits: int) -> DataFrame:
    """What ``rank_entries`` gives for all entries with a row: only entries that can be in it leave the tasks. One row a view."""
    keys = {"_x": F.bround("x", 3), "_z": F.bround("z", 3)}
    placed = views.select("id", "x", "z").withColumns(keys)
    spots = placed.groupBy("_x", "_z").agg(F.min("id").alias("_spot"))
    spotted = placed.alias("p").join(spots.alias("s"), F.col("p._x").eqNullSafe(F.col("s._x")) & F.col("p._z").eqNullSafe(F.col("s._z")))
    there = rows.select("entry_id", "vec").join(spotted.select(F.col("id").alias("entry_id"), "_spot"), "entry_id")
    scored = products.best_groups(queries, there, "entry_id", min(max(1, top_k), 5), digits, 0.0, "_spot")
    return rank_entries(scored.withColumn("score", F.round("score", digits)), views, top_k)


def rank_entries(scored: DataFrame, views: DataFrame, top_k: int) -> DataFrame:
    """Entries by score, one per position on a millimetre grid, five at most."""
    placed = scored.join(views.select(F.col("id").alias("entry_id"), "x", "z", "orientation"), "entry_id")
    spot = placed.withColumns({"_x": F.bround("x", 3), "_z": F.bround("z", 3)})
    one = top(spot, ["query_id", "_x", "_z"], [F.desc("score"), F.asc("entry_id")], 1, "_r").drop("_r", "_x", "_z")
    return top(one, ["query_id"], [F.desc("score"), F.asc("entry_id")], min(max(1, top_k), 5))


def max_similarity(queries: DataFrame, rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Mean over a frame's query vectors of the best similarity in each entry; entries without objects get 0."""
    mean = products.mean_of_queries(queries, rows, "entry_id")
    return entries.select("entry_id").distinct().join(mean, "entry_id", "left").select("entry_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def pooled_similarity(queries: DataFrame, rows: DataFrame, entries: DataFrame, id_col: str, pool: int = 256) -> DataFrame:
    """The same over each query's ``pool`` nearest only: what an entry does not reach counts 0, and nothing counts less."""
    hits = nearest(queries, rows, id_col, pool)
    n = queries.count()
    best = hits.groupBy("query_id", "entry_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("best"))
    total = best.groupBy("entry_id").agg((F.sum("best") / n).alias("score"))
    return entries.select("entry_id").distinct().join(total, "entry_id", "left").select("entry_id", F.coalesce("score", F.lit(0.0)).alias("score"))
