"""Instances, builder records, regions, bundles and shared-storage helpers on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import clustering, components, graph, instances, navigation, parsing, projections, ranks, records, rooms
from quarrylight.sources import bundles
from quarrylight.storage import drop, materialise


def test_rings_find_the_nearest_places(spark):
    r = np.random.default_rng(1)
    xz = np.round(r.uniform(0, 40, (120, 2)), 1).tolist() + [[500.0, 500.0], [501.0, 500.0], [0.0, 900.0]]
    p = spark.createDataFrame([(f"p{i:03d}", x, z) for i, (x, z) in enumerate(xz)], "place_id string, x double, z double")
    pairs = lambda most: sorted((q.a_place_id, q.b_place_id, round(q.distance, 9)) for q in graph.neighbour_pairs(p, 4, None, most).collect())
    assert pairs(0) == pairs(5000) and len(pairs(0)) == 4 * len(xz)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components.connected_components(links, "a", "b").collect()} == {0}
    assert components.connected_components(links.limit(0), "a", "b").count() == 0


def test_numbers_by_ranges(spark):
    df = spark.createDataFrame([(i * i - 50,) for i in range(40)] + [(10**15,)], "k long")
    distinct = df.distinct()
    assert [r.n for r in ranks.numbered(distinct, "k", "n").orderBy("k").collect()] == list(range(distinct.count()))
    assert ranks.numbered(df.limit(0), "k", "n").count() == 0


def test_points_are_spaced(spark):
    r = np.random.default_rng(2)
    xz = r.uniform(0, 5, (80, 2))
    taken = []
    for i, p in enumerate(xz):
        if all(np.hypot(*(p - xz[j])) >= 0.6 for j in taken):
            taken.append(i)
    df = spark.createDataFrame([(i, float(x), float(z)) for i, (x, z) in enumerate(xz)], "k long, x double, z double")
    assert sorted(q.k for q in records.spaced(df, "k", 0.6).collect()) == taken


def test_eigengap_is_at_least_the_components():
    two = np.kron(np.eye(2), np.ones((2, 2)))
    assert clustering.eigengap(two) == 2 and clustering.eigengap(two, 1) == 2 and clustering.eigengap(np.eye(3)) == 3


def test_surroundings_are_cut_before_they_are_filtered(spark):
    near = [None, *({"label": x} for x in "abcdef")]
    docs = [(1, {"visual_feature": [{"type": "sofa", "surrounding_context": near}]}), (2, {"visual_feature": ["x", {"type": "sofa", "surrounding_context": ["x", *near[1:]]}, 3]}), (3, {"visual_feature": [{"type": "sofa", "surrounding_context": "none"}]})]
    rows = parsing.parse_scenes(spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "id int, text string"))
    got = {r.id: [s.label for f in r.features for s in f.surroundings] for r in rows.select("id", "features").collect()}
    assert got == {1: list("abcd"), 2: list("abcd"), 3: []}


def test_valid_objects_need_a_label_and_a_parse(spark):
    df = spark.createDataFrame([(1, "chair", "ok"), (2, "", "ok"), (3, None, "api"), (4, "lamp", None), (5, "Other", "ok"), (6, "bed", "API")], "id int, label string, parse_status string")
    assert [r.id for r in rooms.valid_objects(df).collect()] == [1, 6]
    assert [r.id for r in rooms.valid_objects(df.drop("parse_status")).collect()] == [1, 4, 6]


def test_file_names_in_nested_documents(spark):
    docs = spark.createDataFrame([(1, '{"a":"\\"file_name\\": \\"no\\"","b":[{"c":{"file_name":"x\\u0041.png"}},{"file_name":7}],"file_name":"y"}'), (2, "[]"), (3, None), (4, "no json")], "id int, doc string")
    assert sorted((r.id, r.value) for r in records.file_names(docs, "id", "doc").collect()) == [(1, "xA.png"), (1, "y")]


def test_batch_dedup_of_two_places(spark):
    rows = [("p", 1, "v1", [1.0, 0.0]), ("p", 2, "v2", [0.99, 0.1]), ("p", 3, "v1", [0.0, 1.0]), ("p", 4, "v2", [0.05, 1.0]), ("q", 5, "v3", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "place_id string, object_global_id long, view_id string, vec array<double>")
    got = {r.object_global_id: (r.cluster, r.reason) for r in instances.batch_dedup(df, "place_id").collect()}
    assert got[1][0] == got[2][0] != got[3][0] == got[4][0] and got[5] == (0, "singleton")
    with pytest.raises(ValueError):
        instances.batch_dedup(df.withColumn("vec", F.when(F.col("object_global_id") > 1, F.col("vec"))), "place_id")
    with pytest.raises(ValueError):
        instances.scoped(df, "planet")


def test_pairs_outside_the_vectors_raise(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "row_idx long, vec array<double>")
    pairs = spark.createDataFrame([("a", 0, 1)], "pair_id string, obj_a_id long, obj_b_id long")
    assert instances.pair_scores(pairs, {"short": vectors}).first()["short_cosine"] == pytest.approx(0.5**0.5)
    with pytest.raises(KeyError, match="object 7 is outside the short vectors"):
        instances.pair_scores(pairs.withColumn("obj_b_id", F.lit(7).cast("long")), {"short": vectors})


def test_selected_views_need_enough_objects(spark):
    df = spark.createDataFrame([("v1", 1, "chair", "p1", "unknown", "hall")], "view_id string, object_global_id long, label string, place_id string, room_function string, view_type string")
    with pytest.raises(ValueError):
        instances.selected_view_group(df, ["v1"])
    room = instances.selected_view_group(df, ["v1"], 1)[0].first()
    assert (room.room_function, room.view_type, room.num_objects) == ("selected_views", "hall", 1)
    with pytest.raises(ValueError):
        instances.selected_view_group(df, [" "])


def test_object_record_columns_and_defaults(spark):
    df = spark.createDataFrame([(1, 2, 0.0, 1.0, 270, None, "RIGHT", -30.0)], "object_global_id long, entry_id long, x double, z double, orientation int, label string, laterality string, relative_bearing_deg double")
    row = projections.object_records(df).first()
    assert len(row) >= 60 and row.label == "unknown" and row.object_orientation_deg == 300 and row.attributes == [] and row.bbox_xyxy == [] and row.mask_area_px is None
    assert projections.object_records(df, by_bearing=True).first().object_orientation_deg == 300 and projections.object_records(df, split=False).first().angle_bucket == "center"


def test_regions_and_resampled_paths(spark):
    cells = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (5, 5), (0, 1)], "ix long, iz long")
    got = sorted((r.ix, r.iz, r.size) for r in navigation.grid_regions(cells).collect())
    assert got == [(0, 0, 3), (0, 1, 3), (1, 1, 3), (5, 5, 1)]
    path = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 1.0, 0.0), ("a", 2, 1.0, 1.5), ("b", 0, 3.0, 3.0)], "k string, n0 int, x double, z double")
    points = sorted((r.k, r.n, round(r.x, 6), round(r.z, 6)) for r in navigation.resampled(path, "k", "n0", 1.0).collect())
    assert points == [("a", 0, 0.0, 0.0), ("a", 1, 1.0, 0.0), ("a", 2, 1.0, 1.0), ("a", 3, 1.0, 1.5), ("b", 0, 3.0, 3.0)]


def scene(folder, n=3, dims=4, ids=None, drop_field=None):
    rows = [{"id": i if ids is None else ids[i], "x": 0.0, "y": 1.0, "orientation": 90, "file_name": f"{i}.png"} for i in range(n)]
    for r in rows:
        r.pop(drop_field, None)
    (folder / "meta.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    np.save(folder / "image_emb.npy", np.eye(n, 4, dtype=np.float32))
    np.save(folder / "text_emb_short.npy", np.eye(n, dims, dtype=np.float32))
    (folder / "object_meta.jsonl").write_text("\n".join(json.dumps({"object_global_id": i, "entry_id": i - 1, "label": "chair"}) for i in range(3)))
    np.save(folder / "object_text_emb_short.npy", np.eye(3, 2, dtype=np.float32))


def test_whole_scenes_load_or_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        bundles.load_views(spark, str(tmp_path))
    assert bundles.load_objects(spark, str(tmp_path)) is None
    scene(tmp_path)
    views = bundles.load_views(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [(v.id, v.row_idx, list(v.image_vec).index(1.0)) for v in views] == [(0, 0, 0), (1, 1, 1), (2, 2, 2)]
    objects = bundles.load_objects(spark, str(tmp_path))
    assert sorted((r.entry_id, r.rows) for r in bundles.entry_index(objects).collect()) == [(0, [1]), (1, [2])]
    assert bundles.resumed(spark, str(tmp_path))[0].count() == 3
    for change in ({"dims": 3}, {"drop_field": "file_name"}, {"n": 4, "ids": [0, 1, 2, 3]}):
        scene(tmp_path, **change)
        if change.get("n"):
            np.save(tmp_path / "image_emb.npy", np.eye(3, 4, dtype=np.float32))
        with pytest.raises(ValueError):
            bundles.load_views(spark, str(tmp_path)).count()
    scene(tmp_path, ids=[2, 1, 0])
    assert bundles.resumed(spark, str(tmp_path)) == (None, None)
    with pytest.raises(ValueError):
        bundles.load_views(spark, str(tmp_path), "medium")


def test_a_memory_grows(spark, tmp_path):
    m = bundles.Memory(spark, str(tmp_path / "m"))
    assert m.load().count() == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0], "{}"), (2, [0.0, 1.0], "{}")], "id long, vec array<double>, meta string")
    m.add(rows)
    m.add(rows.where("id = 2").withColumn("id", F.lit(3).cast("long")))
    assert sorted(r.id for r in m.load().collect()) == [1, 2, 3]
    m.save(str(tmp_path / "copy"))
    assert bundles.Memory(spark, str(tmp_path / "copy")).load().count() == 3
    m.reset()
    assert m.load().count() == 0


def test_keyed_merges(spark, tmp_path):
    path, shared = str(tmp_path / "nodes"), str(tmp_path / "shared")
    rows = lambda data: spark.createDataFrame(data, "id long, a string, b long")
    bundles.merge_keyed(spark, path, rows([(1, "x", 1), (2, "y", 2)]), ["id"], shared)
    bundles.merge_keyed(spark, path, rows([(2, None, 5), (3, "z", None)]), ["id"], shared)
    assert sorted((r.id, r.a, r.b) for r in spark.read.parquet(path).collect()) == [(1, "x", 1), (2, "y", 5), (3, "z", None)]
    for bad in ([(1, "x", 1), (1, "y", 2)], [(None, "x", 1)]):
        with pytest.raises(ValueError):
            bundles.merge_keyed(spark, path, rows(bad), ["id"], shared)


def test_bundles_reports_and_jobs(spark, tmp_path):
    metrics = spark.createDataFrame([("short", 0.5, None), ("long", 1.0, 0.25)], "rep string, auc double, ap double")
    assert bundles.summary_markdown(metrics, ["auc", "ap"]).splitlines()[2:] == ["| long | 1.0000 | 0.2500 |", "| short | 0.5000 | n/a |"]
    affinity = spark.createDataFrame([("g", 1, 2, 0.5), ("g", 1, 3, 0.0)], "g string, i long, j long, affinity double")
    cells = {(r.i, r.j): round(r.value, 6) for r in bundles.laplacians(affinity, "g").collect()}
    assert cells[1, 1] == 1 and cells[1, 2] == -1 and cells[3, 3] == 0 and len(cells) == 9
    bundles.write_clusters(str(tmp_path / "out"), "g", labels=affinity, laplacian=bundles.laplacians(affinity, "g"))
    assert spark.read.parquet(str(tmp_path / "out" / "labels")).count() == 2
    bundles.write_json(affinity, str(tmp_path / "json"))
    assert json.loads(spark.read.text(str(tmp_path / "json")).orderBy("value").first().value) == {"g": "g", "i": 1, "j": 2, "affinity": 0.5}
    bundles.write_pairs_csv(affinity, str(tmp_path / "csv"))
    bundles.write_rectangular_csv(affinity, "i", "j", "affinity", str(tmp_path / "rect"), ["2", "3"])
    assert spark.read.option("header", True).csv(str(tmp_path / "rect")).first().asDict() == {"i": "1", "2": "0.500000", "3": "0.000000"}
    for name in ("a/query_1.json", "a/query_2.json", "a/query_object_crop.jpg", "b/query_object_crop.jpg"):
        (tmp_path / "jobs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "jobs" / name).write_text("{}")
    jobs = sorted((r.crop_path[-26:], (r.query_json_path or "")[-12:]) for r in bundles.newest_queries(spark, str(tmp_path / "jobs")).collect())
    assert [j[1] for j in jobs] == ["query_2.json", ""] and bundles.newest_queries(spark, str(tmp_path / "jobs"), limit=1).count() == 1
    bounds = spark.createDataFrame([(0.0, 1.0, None, 2.0)], "min_x double, max_x double, min_z double, max_z double")
    good = bounds.withColumn("min_z", F.lit(3.0))
    assert bundles.first_projection(bounds, good).first().min_z == 3.0
    assert [bundles.backfill_projection(spark, str(tmp_path / "proj"), good, o) for o in (False, False, True)] == ["written", "exists", "written"]


def test_small_helpers(spark):
    assert projections.listed_ids(" 3, 4 ,,4") == [3, 4, 4] and projections.listed_ids("a,b,a", False) == ["a", "b"] and projections.listed_ids(None) == []
    one = spark.range(1)
    lines = one.select(projections.wrapped(F.lit("aa bb  cccccc d"), 5).alias("l"), projections.wrapped(F.lit(" "), 5).alias("e")).first()
    assert list(lines.l) == ["aa bb", "cccccc", "d"] and list(lines.e) == [""]
    payload = one.select(projections.selector_attributes(F.from_json(F.lit('{"view_type":"hall","scene_attributes":[" a ",""]}'), "struct<view_type:string,room_function:string,style_hint:string,clutter_level:string,floor_pattern:string,lighting_ceiling:string,wall_color:string,scene_attributes:array<string>,additional_notes:string,image_summary:string>")).alias("s")).first().s
    assert (payload.view_type, payload.room_function, payload.scene_attributes, payload.image_summary) == ("hall", "unknown", ["a"], "")
    changes = spark.createDataFrame([("s", 0, "new", 0, 1), ("s", 1, "append", 0, 2), ("s", 1, "merge", 0, 1)], "scene string, step int, case string, cluster_id long, object_global_id long")
    steps = {r.step: (r.n_appended, r.n_merged, r.n_new, r.n_objects) for r in instances.step_summaries(changes).collect()}
    assert steps == {0: (0, 0, 1, 1), 1: (1, 1, 0, 1)}
    kept = materialise(one, "t")
    drop(kept)
