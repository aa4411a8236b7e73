"""Hand-computed cases of the scene functions and operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.functions import angles, taxonomy, texts
from quarrylight.operators import clustering, components, graph, incremental, metrics, parsing, relations, similarity, upkeep
from quarrylight.sources import scenes


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_polar_distance_and_phrases(spark):
    n = F.lit(None).cast("double")
    r = one(
        spark, d=angles.polar_distance(F.lit(1.0), F.lit(1.1), F.lit(10.0)),
        a=angles.local_phrase(F.lit(10.0), F.lit(0.1), n), b=angles.local_phrase(F.lit(-25.0), F.lit(-1.0), n), c=angles.local_phrase(F.lit(0.0), F.lit(0.0), F.lit(0.4)),
    )
    assert r.d == pytest.approx(0.20838172514196715)
    assert (r.a, r.b, r.c) == ("slightly right, slightly behind", "left, in front", "above")


def test_projection_and_orientation_signs(spark):
    x, z = angles.project_from_camera(F.lit(0.0), F.lit(0.0), F.lit(270.0), F.lit(-30.0), F.lit(2.0))
    side = F.lit("left")
    r = one(spark, x=x, z=z, build=angles.object_orientation(F.lit(90.0), side, 30.0), ask=angles.object_orientation(F.lit(270.0), side, 30.0, query_side=True), none=angles.project(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0))[0])
    assert (round(r.x, 3), round(r.z, 3)) == (1.732, -1.0)
    assert (r.build, r.ask, r.none) == (60.0, 300.0, None)


def test_view_directions(spark):
    at = lambda dx, dz: angles.view_direction(F.lit(dx), F.lit(dz), F.lit(0.0))
    r = one(spark, a=at(1.0, 0.0), b=at(-1.0, 0.0), c=at(0.0, -1.0), d=at(0.0, 1.0), e=at(0.1, 0.1), f=angles.vertical_direction(F.lit(0.1)))
    assert tuple(r) == ("right", "left", "in front", "behind", None, "level")


def test_safe_cast_and_circle(spark):
    r = one(spark, nan=angles.finite(F.lit(float("nan"))), text=angles.finite(F.lit("x")), wrap=angles.wrapped_delta(F.lit(-180.0)), near=angles.nearest_scan_angle(F.lit(350.0), F.array(F.lit(90.0), F.lit(0.0))))
    assert (r.nan, r.text, r.wrap, r.near) == (None, None, 180.0, 0.0)


def test_labels_and_texts(spark):
    r = one(
        spark, a=taxonomy.canonical_label(F.lit("Arm-Chair")), b=taxonomy.canonical_label(F.lit("glasses")), c=taxonomy.canonical_label(F.lit("benches")),
        d=texts.half_metre(F.lit(1.25)), e=texts.tenth(F.lit(None).cast("double")), f=F.array_join(texts.clean_items(F.array(F.lit(" a "), F.lit("Unknown"), F.lit("a"), F.lit("b")), 3), ","),
        g=F.array_join(taxonomy.selector_subset(F.array(F.lit("sofa"), F.lit("couch"), F.lit("unknown"), F.lit("lamp"))), ","), h=texts.first_usable(F.lit("n/a"), F.lit(" real  text ")),
    )
    assert tuple(r) == ("chair", "other", "bench", "1.0", "na", "a,b", "couch,lamp", "real text")


def test_places_and_direction_edges(spark):
    views = spark.createDataFrame([(i, f"v{i}", 0.0 if i < 4 else 2.0, 0.0, 90 * (i % 4), "dining" if i >= 4 else None, None) for i in range(6)], "id int, view_id string, x double, z double, orientation int, room_function string, view_type string")
    p = graph.places(views)
    rows = {r.place_id: r for r in p.collect()}
    assert len(rows) == 2 and rows["place_00000"].n_views == 4 and rows["place_00001"].room_function == "dining" and rows["place_00000"].room_function == "unknown"
    edges = {(r.source, r.direction, r.target) for r in graph.direction_edges(p).collect()}
    assert edges == {("place_00000", "EAST_OF", "place_00001"), ("place_00001", "WEST_OF", "place_00000")}
    with pytest.raises(ValueError):
        graph.direction_name("up")


def test_two_objects_of_a_view(spark):
    rows = [(1, 0, "a", 0.0, 0.8, 0.0, 0), (2, 0, "b", 1.0, 1.2, 0.0, 0)]
    o = spark.createDataFrame(rows, "object_global_id int, entry_id int, label string, gx double, gy double, gz double, orientation int")
    found = {(r.source_id, r.direction, r.vertical): round(r.distance_3d, 6) for r in relations.object_object(o).collect()}
    assert found == {(1, "right", "above"): 1.077033, (2, "left", "below"): 1.077033}


def test_affinity_policies(spark):
    row = spark.createDataFrame([("g", 0, 1, "v", "v", 0.8)], "g string, i int, j int, i_view_id string, j_view_id string, sim double")
    got = [similarity.constrained(row, "g", p, 0.25).first().affinity for p in ("soft_penalty", "hard_block", "none")]
    assert got == pytest.approx([0.2, 0.0, 0.8])
    with pytest.raises(ValueError):
        similarity.constrained(row, "g", "other")


def test_eigengap_and_spectral():
    blocks = np.kron(np.eye(2), np.full((2, 2), 0.9)) + 0.01
    np.fill_diagonal(blocks, 1)
    assert clustering.eigengap(blocks) == 2
    labels, reason = clustering.spectral(blocks, np.array([7, 3, 1, 2]))
    assert labels.tolist() == [1, 1, 0, 0] and reason == "spectral"
    assert clustering.spectral(np.eye(3), np.arange(3), 2)[1] == "zero_affinity_graph"
    assert clustering.dbscan(np.array([[0.0], [0.1], [5.0], [5.1], [99.0]]), 0.5, 2).tolist() == [0, 0, 1, 1, -1]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (4, 4)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(links, "a", "b").collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)}


def test_metrics(spark):
    s = spark.createDataFrame([("r", 1, 2, 1, 0.9), ("r", 1, 3, 0, 0.5), ("r", 2, 3, 1, 0.5), ("r", 2, 4, 0, 0.1)], "rep string, a int, b int, label int, score double")
    assert metrics.roc_auc(s, ["rep"]).first().auc == pytest.approx(0.875)
    assert metrics.average_precision(s, ["rep"], "b").first().ap == pytest.approx((1 + 2 / 3) / 2)
    best = metrics.best_threshold(s, ["rep"]).first()
    assert (best.threshold, round(best.f1, 6)) == (0.5, 0.8)


def row(i, view, vec, x=0.0):
    return {"object_global_id": i, "view_id": view, "label": "a", "vec": vec, "gx": x, "gy": 0.0, "gz": 0.0, "distance_m": 1.0, "bearing_deg": 0.0, "height_m": 0.0}


def test_incremental_append_new_and_block():
    one_, two = [1.0, 0.0], [0.0, 1.0]
    clusters, following, _ = incremental.advance([], [row(1, "a", one_)], 0)
    clusters, following, events = incremental.advance(clusters, [row(2, "b", one_), row(3, "b", [0.6, 0.8])], following)
    assert [[m["object_global_id"] for m in c.members] for c in clusters] == [[1, 2], [3]]
    assert [e[0] for e in events] == ["append", "new"]
    clusters, following, _ = incremental.advance([], [row(20, "v", one_), row(21, "v", two)], 0)
    clusters, *_ = incremental.advance(clusters, [row(22, "w", one_)], following)
    assert [[m["object_global_id"] for m in c.members] for c in clusters] == [[20, 22], [21]]


def test_scene_documents(spark):
    docs = spark.createDataFrame([(1, 'x {"view_type": "Bedroom", "visual_feature": [{"type": "sofas", "laterality": "RIGHT"}]} y'), (2, ""), (3, None)], "id int, text string")
    rows = {r.id: r for r in parsing.parse_scenes(docs).collect()}
    assert (rows[1].status, rows[1].view_type, rows[1].features[0].type, rows[1].features[0].laterality) == ("ok", "bedroom", "other", "right")
    assert rows[2].status == rows[3].status == "failed"


def test_sources_and_upkeep(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": 1, "x": 2.5}\n\n{"id": 2}\n')
    df = scenes.read_jsonl(spark, str(tmp_path / "t.jsonl"), "id long, x double")
    assert sorted((r.id, r.x) for r in df.collect()) == [(1, 2.5), (2, None)]
    assert scenes.read_jsonl_if_there(spark, str(tmp_path / "none.jsonl"), "id long").count() == 0
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert {r.row_idx: list(r.vec) for r in scenes.read_matrix(spark, str(tmp_path / "m.npy")).collect()}[2] == [4.0, 5.0]
    scenes.write_once(spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, n int"), str(tmp_path / "out"), ["k"], F.col("n"))
    assert spark.read.parquet(str(tmp_path / "out")).first().v == "b"
    attempts = spark.createDataFrame([(1, 0, "failed"), (1, 1, "ok"), (1, 2, "ok")], "id int, attempt int, status string")
    assert upkeep.first_success(attempts, ["id"]).first().attempt == 1


def test_streaming_resolution(spark, tmp_path):
    from quarrylight.streaming.resolution import resolve_stream

    source, schema = str(tmp_path / "in"), incremental.INPUT
    rows = [("s", 0, 1, "a", "l", [1.0, 0.0], 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), ("s", 1, 2, "b", "l", [1.0, 0.0], 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    spark.createDataFrame(rows, schema).write.parquet(source)
    q = resolve_stream(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.case, r.cluster_id, r.object_global_id) for r in spark.table("changes").collect()} == {("seed", 0, 1), ("append", 0, 2)}
