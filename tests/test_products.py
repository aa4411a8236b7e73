"""Scores in blocks against all pairs, and queries whose pairs must not leave their tasks."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from quarrylight.operators import products, search

DATA = "/root/testdata/sf0.001"
FLAT = ["vector_topk", "vector_fused_topk", "retrieve_or_none", "cosine_retrieve", "overlay_groups", "frame_maxsim_pool", "frame_maxsim", "rank_position_dedup", "entry_max_score", "entry_best_match"]


@pytest.mark.parametrize("name", FLAT)
def test_pairs_stay_in_their_tasks(spark, name):
    base = duckdb.connect()
    base.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    df = contract.queries()[name](spark, DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan
    columns = sorted(df.columns)
    found = base.execute(contract.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = [dict(zip(names, row, strict=True)) for row in found.fetchall()]
    key = lambda r: repr([r[c] for c in columns])
    assert sorted(df.select(*columns).toArrow().to_pylist(), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, near copies, vectors that are missing, short, incomplete, zero or not finite; queries of all kinds."""
    random = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in random.integers(-2, 3, (60, 4)) / 4]
    vectors += [vectors[0]] * 6 + [[x + 1e-11 for x in vectors[1]]] * 3 + [None, [1.0, None, 0.0, 0.0], [1.0, 2.0], [], [0.0] * 4, [float("nan"), 0.0, 0.0, 0.0], [float("inf"), 1.0, 1.0, 1.0]]
    rows = spark.createDataFrame([(i, i // 4 if i % 9 else i // 8, v) for i, v in enumerate(vectors)], "id long, entry_id long, vec array<double>")
    queries = rows.where("id % 3 = 0 or id > 66").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    return queries, rows, search.scores(queries, rows).cache()


def table(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("k,digits,others", [(1, 9, True), (5, 9, False), (7, None, False), (200, 9, True)])
def test_nearest_rows(odd, k, digits, others):
    queries, rows, hits = odd
    key = F.round("score", digits) if digits else F.col("score")
    first = lambda df: search.top(df, ["query_id"], [F.desc(key), F.asc("id")], k).select("query_id", "id", "score", "rank")
    assert table(first(products.nearest_rows(queries, rows, "id", k, digits, others))) == table(first(hits.where("id <> query_id") if others else hits))


def test_best_rows_of_groups(odd):
    queries, rows, hits = odd
    finite = "not array_contains(vec, double('inf')) or vec is null"
    some = rows.where(finite)
    want = search.top(hits.join(some.select("id"), "id").where("score is not null"), ["query_id", "entry_id"], [F.desc(F.round("score", 9)), F.asc("id")], 1).select("query_id", "entry_id", "id", "score")
    assert table(products.best_in_groups(queries, some, "entry_id", "id", 9).where("score is not null")) == table(want)


def test_best_groups(odd):
    queries, rows, hits = odd
    entries = hits.groupBy("query_id", "entry_id").agg(F.max("score").alias("score"))
    first = lambda df: search.top(df, ["query_id"], [F.desc(F.round("score", 9)), F.asc("entry_id")], 3).select("query_id", "entry_id", "score")
    assert table(first(products.best_groups(queries, rows, "entry_id", 3, 9))) == table(first(entries))
    clamped = entries.withColumn("score", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0))).withColumn("spot", F.col("entry_id") % 5)
    apart = search.top(clamped, ["query_id", "spot"], [F.desc(F.round("score", 9)), F.asc("entry_id")], 1).drop("rank")
    spotted = rows.withColumn("spot", F.col("entry_id") % 5)
    assert table(first(products.best_groups(queries, spotted, "entry_id", 3, 9, 0.0, "spot"))) == table(first(apart))


def test_over_queries(odd):
    queries, rows, hits = odd
    best = products.best_of_queries(queries, rows, "id").groupBy("id").agg(F.max("score").alias("score"))
    assert table(best) == table(hits.groupBy("id").agg(F.max("score").alias("score")))
    finite = rows.where("id < 71")
    asked = queries.where("query_id < 72")
    means = hits.where("id < 71 and query_id < 72").groupBy("query_id", "entry_id").agg(F.max("score").alias("s")).groupBy("entry_id").agg(F.round(F.avg("s"), 9).alias("score"))
    assert table(products.mean_of_queries(asked, finite, "entry_id").withColumn("score", F.round("score", 9))) == table(means)


def test_several_passes_and_empty_sides(odd, monkeypatch):
    queries, rows, _ = odd
    whole = table(products.nearest_rows(queries, rows, "id", 5, 9).where("score > 0"))
    monkeypatch.setattr(products, "BLOCK", 7)
    first = lambda df: search.top(df, ["query_id"], [F.desc(F.round("score", 9)), F.asc("id")], 5).where("score > 0").select("query_id", "id", "score")
    many = products.nearest_rows(queries, rows, "id", 5, 9)
    assert table(first(many)) == table(first(search.scores(queries, rows))) and whole
    assert products.nearest_rows(queries.limit(0), rows, "id", 5).count() == products.nearest_rows(queries, rows.limit(0), "id", 5).count() == 0


def test_rounding_is_that_of_spark(spark):
    values = [0.5e-9, 1.5e-9, -2.5e-9, 0.1234567885, 0.1234567895, 1234.0000000005, -0.0, 3e12 + 0.123, 1e300, float("nan"), float("inf")]
    want = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 9).alias("v")).collect()]
    np.testing.assert_array_equal(products.rounded(np.array(values), 9), np.array(want))


def test_queries_that_meet_rows_in_blocks(odd, monkeypatch):
    queries, rows, hits = odd
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 1)
    monkeypatch.setattr(search, "BLOCK", 10)
    assert table(search.scores(queries, rows)) == table(hits)
    empty = search.entry_scores(queries, rows, "id", rows.select((F.col("entry_id") + 15).alias("entry_id"))).where("entry_id > 19")
    assert {r.score for r in empty.collect()} == {0.0}


def test_few_groups_among_the_best(spark):
    """Slices after the first, of which few groups can be among the best; copies over many slices."""
    random = np.random.default_rng(8)
    vectors = random.integers(-3, 4, (24000, 6)) / 4
    rows = spark.createDataFrame([(i, i // 3, list(map(float, v))) for i, v in enumerate(vectors)], "id long, entry_id long, vec array<double>")
    rows = rows.withColumn("spot", F.floor(F.col("entry_id") / 4))
    queries = rows.where("id % 800 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    hits = search.scores(queries, rows).groupBy("query_id", "entry_id", "spot").agg(F.max("score").alias("score")).cache()
    first = lambda df, k, keys=("query_id",): search.top(df, list(keys), [F.desc(F.round("score", 9)), F.asc("entry_id")], k).drop("rank")
    assert table(first(products.best_groups(queries, rows, "entry_id", 5, 9), 5)) == table(first(hits.drop("spot"), 5))
    apart = first(hits.withColumn("score", F.greatest("score", F.lit(0.0))), 1, ("query_id", "spot")).drop("spot")
    assert table(first(products.best_groups(queries, rows, "entry_id", 5, 9, 0.0, "spot"), 5)) == table(first(apart, 5))
