"""Long identifiers, and candidate pairs that are found without all pairs of a label."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract
from quarrylight.operators import mining


def same_as_sql(spark, name, folder):
    base = duckdb.connect()
    base.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    df = contract.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    found = base.execute(contract.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = [dict(zip(names, row, strict=True)) for row in found.fetchall()]
    key = lambda r: repr([r[c] for c in columns])
    assert sorted(df.select(*columns).toArrow().to_pylist(), key=key) == sorted(want, key=key)


def write(folder, ids):
    vectors = np.random.default_rng(1).normal(size=(len(ids), 4)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(vectors), pa.list_(pa.float32())), "label": pa.array([i * 7 // 3 % 10 for i in ids], pa.int32())}), f"{folder}/embeddings.parquet")


def test_object_records_with_long_identifiers(spark, tmp_path):
    write(tmp_path, [5, 99, 999, 1000, 1001, 54321])
    same_as_sql(spark, "object_records", tmp_path)


# candidate pairs


def brute(rows, edges, n):
    """All pairs, one by one."""
    import math
    import re

    words = lambda r: {t for t in re.findall("[a-z0-9]+", f"{r['label']} {r['description']}".lower()) if len(t) >= 3}
    share = lambda d, reach: 0.0 if d is None else max(0.0, 1 - min(d, reach) / reach)
    near = {frozenset(e) for e in edges}
    buckets, tricky = {}, []
    for a in rows:
        for b in rows:
            if a["object_global_id"] >= b["object_global_id"]:
                continue
            both, here = words(a) | words(b), a["place_id"] is not None and a["place_id"] == b["place_id"]
            jac = len(words(a) & words(b)) / len(both) if both else 0.0
            d = None if None in (a["gx"], b["gx"]) else math.hypot(a["gx"] - b["gx"], a["gz"] - b["gz"])
            ids = (a["object_global_id"], b["object_global_id"])
            if a["label"] == b["label"]:
                if here:
                    found = "same_label_same_place", 1.5 + jac + 0.25 * (a["view_id"] != b["view_id"]) + share(d, 4)
                elif frozenset((a["place_id"], b["place_id"])) in near:
                    found = "same_label_adjacent_place", 1 + jac + share(d, 6)
                else:
                    found = "same_label_distant_place", jac + share(d, 10)
                if "mirror" in a["description"] + b["description"]:
                    tricky.append((-round(1.5 + jac, 6), *ids))
            elif here:
                found = "different_label_same_place", 0.25 + 0.5 * (a["distance_bin"] == b["distance_bin"]) + 0.25 * (a["laterality"] == b["laterality"]) + 0.25 * (a["verticality"] == b["verticality"])
            else:
                continue
            buckets.setdefault(found[0], []).append((-round(found[1], 9), *ids))
    return {k: [(round(-s, 6), i, j) for s, i, j in sorted(v)[:n]] for k, v in buckets.items()}, [(-s, i, j) for s, i, j in sorted(tricky)[:n]]


SCHEMA = "object_global_id long, label string, place_id string, view_id string, gx double, gz double, laterality string, distance_bin string, verticality string, description string"


@pytest.mark.parametrize("kind", ["spread", "one spot", "unlocated", "all texts differ", "few", "no place"])
@pytest.mark.parametrize("n", [3, 40])
def test_pairs_against_all_pairs(spark, kind, n):
    random = np.random.default_rng(5)
    rows = []
    for i in map(int, random.permutation(7 if kind == "few" else 130)):
        place = None if kind == "no place" and i % 3 else f"p{int(random.integers(6))}"
        x, z = (None, None) if kind == "unlocated" or i % 13 == 0 else (1.0, 2.0) if kind == "one spot" else (float(v) for v in random.uniform(0, 40, 2))
        text = f"word{i} more{i % 4}" if kind == "all texts differ" else ("seen in mirror", "old oak", "oak")[int(random.integers(3))]
        rows.append(dict(zip([c.split()[0] for c in SCHEMA.split(", ")], (i, "ab"[i % 2] * 3, place, f"{place}v{i % 3}", x, z, "lr"[i % 2], "nf"[i % 3 // 2], "hl"[i % 5 // 3], text + (" mirror" if i % 9 == 0 else "")), strict=True)))
    edges = [("p0", "p1"), ("p1", "p2"), ("p4", "p3")]
    objects = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    want, tricky = brute(rows, edges, n)
    got = {}
    for r in mining.candidate_pairs(objects, spark.createDataFrame(edges, "source string, target string"), n).orderBy("rank").collect():
        got.setdefault(r.bucket, []).append((round(r.score, 6), r.obj_a_id, r.obj_b_id))
    assert got == want
    assert [(round(r.score, 6), r.obj_a_id, r.obj_b_id) for r in mining.tricky_pairs(objects, n).orderBy("rank").collect()] == tricky


def test_labels_alone_join_no_pairs(spark):
    data = "/root/testdata/sf0.001"
    joins = lambda name: [line for line in contract.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert joins("tricky_pairs") == []
    assert joins("mine_pairs") and all("place_id" in line for line in joins("mine_pairs"))
