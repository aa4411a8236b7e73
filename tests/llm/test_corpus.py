"""The corpus operators on small tables, against brute force, and on nulls, ties, repeats, long texts and clashing names."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylight.llm import annindex, exact, kdshard, minhash, mixing, packing, quality, rlbwt, runindex, textbytes, toolchat, toxicity
from quarrylight.llm import queries as registered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, size string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared, rows = line(25), []
    for i in range(n):
        text = line(r.randint(1, 120))
        if i % 4 == 1:
            text = text + "\n" + shared + " " + line(5)
        if i % 5 == 2 and rows:
            words = r.choice(rows)[1].split(" ")
            words[r.randrange(len(words))] = "zzz"
            text = " ".join(words)
        if i % 7 == 3 and rows:
            text = r.choice(rows)[1].replace(" ", "  \t", 1)
        rows.append((i * 3, text))
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "One"), (504, "one"), (505, "ü" * 40 + " \x00 <|endoftext|> é"), (506, line(4000))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 10 == 0 else f"s{i % 3}", None, "clash", "clash") for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_exact_dedup(docs, none):
    norm = {i: " ".join([""] * 0) or __import__("re").sub(r"[\x20\x09-\x0d]+", " ", t or "") for i, t in corpus()}
    got = {r.row.doc_id: r for r in exact.exact_dedup(docs).collect()}
    assert len(got) == len(norm)
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest())
    assert exact.exact_dedup(none).count() == 0
    assert exact.keep_first(docs).columns == docs.columns


@pytest.mark.parametrize("task_bytes", [32_000_000, 600, 100])
def test_exact_dedup_hot_groups_on_each_side_of_the_limit(spark, task_bytes):
    rows = [(i, "copy  it") for i in range(40)] + [(0, "copy it"), (None, "copy it"), (7, "alone")] + [(None, "none")] * 50 + [(None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = exact.exact_dedup(df, task_bytes=task_bytes).select("row.*", "keep_id", "group_size", "kept").collect()
    assert len(got) == len(rows)
    for text, want in (("copy it", (0, 42)), ("alone", (7, 1)), ("none", (None, 50)), ("", (3, 2))):
        group = [r for r in got if " ".join((r.text or "").split()) == text]
        assert {(r.keep_id, r.group_size) for r in group} == {want} and sum(r.kept for r in group) == 1


def test_mixing(docs, none, spark):
    got = by_id(mixing.mix_sources(docs))
    sizes = {i: len((t or "").encode().split()) for i, t in corpus()}
    assert {i: r["size"] for i, r in got.items()} == sizes
    targets = {(r.source_size, r.target) for r in got.values()}
    assert sum(t for _, t in targets) == pytest.approx(1.5 * sum(sizes.values())) and all(t <= 2 * s + 1e-9 for s, t in targets)
    assert all(r.taken <= 2 * r["size"] and r.taken % max(1, r["size"]) == 0 for r in got.values())
    assert {i: r.taken for i, r in by_id(mixing.mix_sources(docs.repartition(5))).items()} == {i: r.taken for i, r in got.items()}
    assert mixing.mix_sources(none).count() == 0


def test_mixing_reshares_the_excess(spark):
    sizes = spark.createDataFrame([(False, "a", 10), (False, "b", 1000), (False, "c", 1000), (True, "", 40)], "missing boolean, name string, source_size long")
    got = {r.name: r.target for r in mixing.targets(sizes).collect()}
    # a and the last reach their caps; b and c share the rest 1 : 2
    rest = 1.5 * 2050 - 20 - 80
    assert got == pytest.approx({"a": 20.0, "": 80.0, "b": rest / 3, "c": rest * 2 / 3} if rest * 2 / 3 <= 2000 else {"a": 20.0, "": 80.0, "b": rest - 2000, "c": 2000.0})


def test_kd_shards(docs, none, spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.md5(F.col("id").cast("string")), (F.col("id") % 20 + 1).cast("int")).alias("text"), F.lit("en").alias("lang"), (F.col("id") % 4).cast("string").alias("source"))
    got = pd.DataFrame([r.asDict() for r in kdshard.kd_shards(many, 10).collect()])
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 10 and load.max() / load.min() < 1.05 and len(got) == 3000
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    small = by_id(kdshard.kd_shards(docs, 40))
    texts = dict(corpus())
    assert all(r.text_crc32 == zlib.crc32((texts[i] or "").encode()) and r["size"] == len((texts[i] or "").encode()) + 16 and 0 <= r.shard < 40 for i, r in small.items())
    assert kdshard.kd_shards(none).count() == 0


@pytest.mark.parametrize("shards", [10, 40, 3])
def test_kd_shards_keep_equal_texts_together(spark, shards):
    i = F.col("id")
    text = F.when(i < 900, F.lit("copy " * 20)).when(i < 1100, F.lit("other " * 20)).when(i < 1150, F.lit("third " * 22)).otherwise(F.repeat(F.md5(i.cast("string")), (i % 6 + 1).cast("int")))
    many = spark.range(3000).select(i.alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), (i % 4).cast("string").alias("source"))
    got = pd.DataFrame([r.asDict() for r in kdshard.kd_shards(many.unionByName(many.where("doc_id = 2000")), shards).collect()])
    load = got.groupby("shard")["size"].sum()
    assert len(got) == 3001 and len(load) == shards and load.max() / load.min() < 1.05
    leaf = got["size"].sum() / shards
    for a, b in ((0, 900), (900, 1100), (1100, 1150)):
        group = got[(got.doc_id >= a) & (got.doc_id < b)]
        assert group.shard.nunique() <= (1 if group["size"].sum() <= leaf else np.ceil(group["size"].sum() / leaf) + 1)
    assert got[got.doc_id == 2000].shard.nunique() == 1


def test_kd_shards_of_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, None, None), (None, "", "x", "y"), (2**62, "long " * 5000, None, "y"), (-5, "a", "b", None)], "doc_id long, text string, lang string, source string")
    got = kdshard.kd_shards(odd, 4).collect()
    assert sorted(r["size"] for r in got) == [16, 16, 17, 25016] and all(0 <= r.shard < 4 for r in got)


def plain_sets(rows, k):
    """Shingles by their words: ASCII letters in lower case, divided at white space."""
    out = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
        out[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
    return out


def brute_components(rows, k):
    sets = plain_sets(rows, k)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, sets


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, none, k):
    want, sets = brute_components(corpus(), k)
    got = by_id(minhash.near_duplicates(docs, k))
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == want[i]) for i, r in got.items())
    if k == 2:
        assert minhash.near_duplicates(none, k).count() == 0
        assert len({r.component_id for i, r in got.items() if i in (503, 504)}) == 1


def test_near_duplicates_chain_and_large_group(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        words = list(base)
        words[(i * 7) % 100] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows + [(None, "w0 w1 w2")], "doc_id long, text string")
    want, _ = brute_components(rows, 2)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2).collect()}
    assert got.pop(None) is None and got == want


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_at_the_threshold(spark, k):
    """Groups of near copies around 0.8 in which hardly any signature says enough; the match threshold changes nothing."""
    r = random.Random(5)
    vocabulary, rows = [f"w{i}" for i in range(200)], []
    for length in (12, 40, 100, 160):
        base = [r.choice(vocabulary) for _ in range(length)]
        for _ in range(40):
            words = list(base)
            for _ in range(r.randint(0, max(1, length // 8))):
                words[r.randrange(length)] = r.choice(vocabulary)
            rows.append((2 * len(rows) + 1, " ".join(words)))
    want, sets = brute_components(rows, k)
    assert 10 < len(set(want.values())) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for needed in (None, 92):
        got = by_id(minhash.near_duplicates(df, k, chunk_bytes=20_000, bucket_bytes=5_000, needed=needed))
        assert {i: (x.component_id, x.n_shingles) for i, x in got.items()} == {i: (want[i], len(sets[i])) for i in want}


def test_near_duplicates_of_rows_that_share_an_identifier(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(7, "another text of its own"), (7, " ".join(base)), (9, " ".join(["x", *base[1:]])), (9, " ".join(["x", *base[1:]]))]
    got = [(r.component_id, r.kept, r.n_shingles) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).orderBy("doc_id", "n_shingles").collect()]
    assert got == [(7, True, 4), (7, True, 59), (7, False, 59), (7, False, 59)]


def test_shingles_of_odd_words():
    texts = ["x" * 300 + " y", "X" * 300 + "\ty", "\x1c\x85 \u2003", "a" * 8 + " " + "a" * 16, None, "é É"]
    sets = list(textbytes.shingle_sets(texts, 1))
    assert [len(s) for s in sets] == [2, 2, 2, 2, 0, 2] and (sets[0] == sets[1]).all()
    for k in (1, 2, 5):
        many = [t for _, t in corpus(7)]
        assert [len(s) for s in textbytes.shingle_sets(many, k)] == [len(s) for s in plain_sets(enumerate(many), k).values()]


def brute_repeats(rows):
    top, first, out = 2**63 - 1, {}, []
    texts = [(top if i is None else i, i, (t or "").encode()) for i, t in rows]
    for order, _, b in texts:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], 2**64), order)
    for order, i, b in texts:
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < order:
                gone[p : p + 50] = True
        left = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(spark, none):
    rows = corpus()
    rows += [(2**63 - 1, rows[3][1] + " tail"), (None, rows[5][1]), (None, "b" * 400), (9000, "a" * 3000), (9001, "a" * 500 + "b" * 60), (777, rows[5][1] + rows[6][1]), (777, rows[5][1])]
    want, df = brute_repeats(rows), spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size, hot in ((2_000_000, 4096), (3_000, 3)):
        got = runindex.remove_repeats(df, chunk_bytes=size, bucket_bytes=4_000, hot=hot).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == want
    assert sum(w[2] for w in want) > 1000 and not [t for t in spark.catalog.listTables() if t.name.startswith("chunks")]
    assert runindex.remove_repeats(none).count() == 0


def test_anchors_fall_evenly_into_buckets():
    body = np.random.default_rng(1).integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    chunk = runindex.Chunk({
        "ids": np.array([1], dtype="<i8").tobytes(), "missing": np.array([False]).tobytes(),
        "lengths": np.array([len(body)], dtype="<i8").tobytes(), "body": runindex.zstandard.compress(body),
    })
    held = np.diff(runindex._bucket_cuts(chunk.anchors()[0], 5))
    assert held.sum() > 10_000 and held.max() < 1.5 * held.mean()


def test_run_compressed_index_against_brute_force():
    r = random.Random(1)
    for trial in range(40):
        width, alphabet = r.choice([5, 8]), "ab" if trial % 2 else "abcdefgh"
        base, contents, docs, groups = [("".join(r.choice(alphabet) for _ in range(40))).encode() for _ in range(3)], [], [], []
        for _ in range(r.choice([1, 2, 9, 30])):
            b = bytearray(r.choice(base)[r.randint(0, 20) :])[: r.randint(width, 40)]
            b[r.randrange(len(b))] = ord(r.choice(alphabet))
            contents.append(bytes(b) if r.random() < 0.9 else b"a" * r.randint(width, 300))
            docs.append(r.randint(0, 12)), groups.append(r.randrange(3) * 10**12)
        lengths = np.array([len(c) for c in contents])
        got = rlbwt.in_smaller(np.frombuffer(b"".join(contents), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths, np.array(docs), np.array(groups), width, piece=r.choice([3, 128]))
        want = [
            any(groups[j] == groups[i] and docs[j] < docs[i] and c[p : p + width] in contents[j] for j in range(len(contents)))
            for i, c in enumerate(contents) for p in range(len(c) - width + 1)
        ]
        assert got.tolist() == want


def test_packing(docs, none):
    own = Tokenizer.from_file(TOKENIZER)
    ids = {i: np.array(own.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for i, t in corpus()}
    got = pd.DataFrame([r.asDict() for r in packing.pack(docs, TOKENIZER).collect()])
    for r in got.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert g.start.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() == len(ids[i])
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024
    assert (got.groupby("sequence_id").length.sum() < 1024).sum() <= 1
    assert packing.pack(none, TOKENIZER).count() == 0


def test_packing_of_long_runs_and_repeated_rows(spark):
    own = Tokenizer.from_file(TOKENIZER)
    encoder = packing.Encoder(TOKENIZER)
    for text in ("a" + " " * 1_200_000 + "b", "\n" * 10_000, "x" * 150_000, " " * 9_999 + "b"):
        assert encoder.ids(text) == own.encode(text, add_special_tokens=False).ids
    r = random.Random(3)
    for _ in range(300):
        text = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x250), r.randrange(0x2000, 0x3100), r.randrange(0x1F300, 0x1F700), 10, 9, 32])) for _ in range(60))
        assert encoder.ids(text) == own.encode(text, add_special_tokens=False).ids
    rows = [(None, "")] * 900 + [(1, "same text here")] * 900 + [(i, f"text {i} of many words") for i in range(2, 600)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), TOKENIZER, window=64, shard_rows=200)
    assert got.groupBy(F.shiftright("sequence_id", 32)).count().agg(F.max("count")).first()[0] < 600 and got.where("start = 0").count() == len(rows)


def test_tasks_of_a_worker_share_an_encoder(tmp_path):
    path = tmp_path / "tokenizer.json"
    path.write_bytes(open(TOKENIZER, "rb").read())
    kept = packing.encoder(str(path))
    assert kept.ids("two words") == Tokenizer.from_file(TOKENIZER).encode("two words", add_special_tokens=False).ids
    assert packing.encoder(str(path)) is kept and "own" not in vars(kept)
    assert kept.vocabulary == Tokenizer.from_file(TOKENIZER).get_vocab_size()
    assert kept.ids(kept.special[0]) == kept.own.encode(kept.special[0], add_special_tokens=False).ids
    os.utime(path, ns=(1, 1))  # another file at the same place is read again
    assert packing.encoder(str(path)) is not kept


def test_bm25_scores_against_the_formula():
    r = np.random.default_rng(2)
    tails = [r.integers(0, 30, r.integers(1, 60)) for _ in range(25)]
    df = np.array([sum(t in x for x in tails) for t in range(30)])
    mean = np.mean([len(t) for t in tails])
    index = packing.Index(tails, df, len(tails), mean)
    for seed in range(25):
        weight = lambda i, t: np.log(1 + (25 - df[t] + 0.5) / (df[t] + 0.5)) * (f := (tails[i] == t).sum()) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(tails[i]) / mean))
        terms = sorted(set(tails[seed]), key=lambda t: (-weight(seed, t), t))[:12]
        assert set(index.query[seed].tolist()) == set(terms)
        assert np.allclose(index.scores(seed), [sum(weight(i, t) for t in terms) for i in range(25)])


def test_packing_prefers_related_tails():
    tails = [np.array([1, 2, 3] * 10), np.array([7, 8, 9] * 10), np.array([1, 2, 3] * 10), np.array([7, 8, 9] * 10)]
    index = packing.Index(tails, np.full(10, 2), 4, 30.0)
    assert [{p[0] for p in s} for s in packing.fill_windows(tails, index, 60)] == [{0, 2}, {1, 3}]


def test_nearest_neighbours(spark):
    x = np.random.default_rng(3).normal(size=(1500, 16)).astype(np.float32)
    x[700:760] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0]), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = pd.DataFrame([r.asDict() for r in annindex.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=600, query_block=10).collect()])
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(mine.score, s[mine.vec_id])
        hit += len(set(mine.vec_id) & set(want))
    assert hit / (30 * 5) >= 0.9
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == [700, 701, 702, 703, 704]
    assert set(got.query_id) == set(range(0, 1500, 50))
    assert annindex.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 1, 2, 50) or vec_id is null").unionByName(df.where("vec_id = 1"))
    assert sorted((r.query_id, r["rank"]) for r in annindex.nearest(few, few.where("vec_id % 50 = 0")).collect()) == [(q, i) for q in (0, 50) for i in (1, 2, 3)]


def test_beams_leave_a_group_of_near_copies():
    r = np.random.default_rng(0)
    x = r.normal(size=(2500, 64))
    x[1500:] = x[8] + 0.01 * r.normal(size=(1000, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph, start = annindex.build_graph(unit.astype(np.float32))
    asked = np.arange(0, 2500, 50)
    found, _ = annindex.beam_search(unit.astype(np.float32), graph, start, unit[asked].astype(np.float32), annindex.SEARCH_BEAM)
    want = np.argsort(-(unit[asked] @ unit.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(found.tolist(), want.tolist())]) >= 0.95


def test_quality_and_toxicity(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("clash"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r for r in labels.collect()}
    for module, column, least in ((quality, "quality", 0.9), (toxicity, "toxic", 0.9)):
        got = by_id(module.score_documents(docs, labels))
        held = [(r.predicted, truth[i][column]) for i, r in got.items() if r.held_out and i in truth]
        assert len(got) == 1000 and np.mean([p == t for p, t in held]) >= least
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
        nothing = labels.limit(0)
        assert module.score_documents(none, nothing).count() == 0
        odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
        assert module.score_documents(odd, nothing).count() == 3
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_flattened_trees_match_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.fit_forest(x, y, trees=20)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95

    def walk(v):
        raw = forest.base
        for i in forest.roots:
            while forest.feature[i] >= 0:
                i = forest.left[i] + int(v[forest.feature[i]] > forest.threshold[i])
            raw += forest.value[i]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose(forest.score(x[:50]), [walk(v) for v in x[:50]])


def test_first_tree_takes_the_best_split():
    """Against all splits of all features, by the gain of the logistic loss."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 4)), None
    y = (x[:, 2] + 0.3 * rng.normal(size=300) > 0.4).astype(float)
    forest = quality.fit_forest(x, y, trees=1, depth=1, bins=64)
    p = y.mean()
    g, h, best = p - y, np.full(300, p * (1 - p)), (-1.0, None)
    for j in range(4):
        for edge in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1], method="lower")):
            low = x[:, j] <= edge
            if min(low.sum(), (~low).sum()) >= quality.LEAST_ROWS:
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + quality.L2) for m in (low, ~low))
                best = max(best, (gain, (j, edge)), key=lambda b: b[0])
    root = forest.roots[0]
    assert (int(forest.feature[root]), float(forest.threshold[root])) == best[1]
    low = x[:, best[1][0]] <= best[1][1]
    for side, rows in enumerate((low, ~low)):
        assert np.isclose(forest.value[forest.left[root] + side], -quality.RATE * g[rows].sum() / (h[rows].sum() + quality.L2))


def test_statistics_of_odd_texts():
    for t in (None, "", " ", "a" * 100_000, "\n\n", "x y " * 50_000, "\x00\ud800".encode("utf-8", "surrogatepass").decode("utf-8", "replace")):
        s = quality.statistics(t)
        assert len(s) == len(quality.FEATURES) and all(np.isfinite(s))


def test_labels_that_disagree_or_are_null(spark):
    docs = spark.createDataFrame([(i, f"{'good words here' if i % 2 else '#### ???? $$$$'} {i}") for i in range(200)], "doc_id long, text string")
    marks = [(i, i % 2) for i in range(200)] + [(4, 1), (6, None), (None, 1), (999, 1)]
    labels = spark.createDataFrame([(i, q, 1 - q if q is not None else None) for i, q in marks], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        got = by_id(module.score_documents(docs, labels))
        assert len(got) == 200 and all(0 <= r.score <= 1 for r in got.values())
    one_kind = labels.where("quality = 1")
    assert {r.score for r in quality.score_documents(docs, one_kind).collect()} != set() and toxicity.score_documents(docs, one_kind).count() == 200


def test_swaps_that_meet_their_substitute():
    h = toxicity.word_hash
    alone = toxicity.swaps_in("the women came")
    assert alone == [h("women") * toxicity.HASHES + h("men")]
    both = toxicity.swaps_in("women and men came. the end")
    assert sorted(both) == sorted(h(t) * toxicity.HASHES + h(t) for t in ("women", "men"))


def test_identity_terms_get_like_weights():
    terms = [toxicity.word_hash(w) for w in ("muslim", "christian")]
    bad = toxicity.word_hash("bad")
    hashes = np.array(sorted([*terms, bad]))
    sets = [np.array(sorted([terms[0], bad]))] * 20 + [np.array([terms[0]])] * 5 + [np.array([terms[1]])] * 25
    y = np.array([1] * 20 + [0] * 30)
    swaps = {a * toxicity.HASHES + b: 1 for a in terms for b in terms if a != b}
    gap = lambda m: abs(m.weight_of()[terms[0]] - m.weight_of()[terms[1]])
    assert gap(toxicity.fit(sets, y, hashes, swaps)) < 0.5 * gap(toxicity.fit(sets, y, hashes, {}))


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [("c", "1", 1, "add", '{"b":2,"a":1.5}', []), ("c", "2", 2, "add", '{"a":"x"}', ["3"]), ("c", "3", 3, "add", "[1]", ["1"]), ("c", "4", 4, "none", "{}", ["9"]), ("d", "1", 1, "add", None, ["2"]), ("d", "2", 2, "add", '{"a":1}', ["1"]), ("c", None, 9, "add", "{}", []), ("c", "1", 7, "add", "{}", [])],
        "conv string, call_id string, seq long, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([("c", "1", 5, "ok"), ("c", "1", 6, "again"), ("c", "8", 7, "lost")], "conv string, call_id string, seq long, content string")
    got = {(r.conv, r.call_id): r for r in toolchat.link_tool_calls(calls, results, {"add": {"a": ("number", True), "b": ("integer", False)}}).collect()}
    assert got["c", "1"].message == '{"arguments":{"a":1.5,"b":2},"id":"1","name":"add","result":"ok"}'
    assert (got["c", "1"].n_calls, got["c", "1"].n_results, got["c", "1"].errors) == (2, 2, [])
    assert got["c", "2"].errors == ["type:a"] and got["c", "3"].errors == ["not_an_object"] and got["c", "4"].errors == ["unknown_tool"]
    assert got["c", "4"].missing_deps == 1 and got["c", "8"].status == "orphan_result" and got["c", "3"].status == "unanswered"
    order = {k[1]: r.topo_order for k, r in got.items() if k[0] == "c" and r.topo_order}
    assert order["1"] < order["3"] < order["2"]
    assert got["d", "1"].cyclic and got["d", "2"].cyclic and not got["c", "1"].cyclic
    assert toolchat.link_tool_calls(calls.limit(0), results.limit(0), {}).count() == 0


def test_tool_calls_of_odd_arguments(spark):
    rows = [("c", str(i), i, "t", a, []) for i, a in enumerate(['{"a":1,"a":2}', '{"a":' + "9" * 45 + "}", '{"a":"' + "x" * 100_000 + '"}', '{"b":[1,{"d":null,"c":2}],"a":"x"}'])]
    calls = spark.createDataFrame(rows, "conv string, call_id string, seq long, name string, arguments string, depends_on array<string>")
    got = {r.call_id: r for r in toolchat.link_tool_calls(calls, calls.select("conv", "call_id", "seq", F.lit(None).cast("string").alias("content")), {"t": {"a": ("string", True)}}).collect()}
    assert got["0"].errors == ["not_an_object"] and got["1"].errors == ["type:a"] and got["2"].errors == [] and len(got["2"].message) > 100_000
    assert got["3"].message == '{"arguments":{"a":"x","b":[1,{"c":2,"d":null}]},"id":"3","name":"t","result":null}'


def test_calls_that_wait_for_later_calls(spark):
    edges = [("1", []), ("2", ["5"]), ("3", ["2"]), ("4", ["1"]), ("5", ["4"]), ("6", ["7"]), ("7", ["6"]), ("8", ["7"]), ("9", ["9"])]
    calls = spark.createDataFrame([("c", i, int(i), "t", "{}", d) for i, d in edges], "conv string, call_id string, seq long, name string, arguments string, depends_on array<string>")
    got = sorted(toolchat.link_tool_calls(calls, calls.select("conv", "call_id", "seq", F.lit("r").alias("content")), {"t": {}}).collect(), key=lambda r: r.topo_order)
    assert [r.call_id for r in got] == ["1", "4", "5", "2", "3", "6", "7", "8", "9"] and [r.call_id for r in got if r.cyclic] == ["6", "7", "8", "9"]


def test_conversation_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", "more"), (None, 0, "user", "x"), (2, 0, "assistant", "y"), (3, 0, "system", "s"), (3, 1, None, "z")], "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in toolchat.link_tool_calls(*toolchat.turns_as_calls(turns), toolchat.TURN_SCHEMAS).collect()}
    assert got["1:0"].status == "linked" and got["1:2"].status == "unanswered" and got["2:-1"].status == "orphan_result" and got["1:1:note"].status == "linked"
    assert got["1:2"].topo_order == 3 and got["1:0"].errors == [] and got["3:0:system"].errors == [] and got["3:1:"].errors == ["unknown_tool"] and len(got) == 7


def test_turns_reach_every_branch(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = toolchat.link_tool_calls(*toolchat.turns_as_calls(turns), toolchat.TURN_SCHEMAS).collect()
    seen = {e for r in rows for e in r.errors}
    assert {"not_an_object", "unknown_tool", "missing:turn", "type:turn"} <= seen and {r.status for r in rows} == {"linked", "unanswered", "orphan_result"}
    assert any(r.cyclic for r in rows) and any(r.missing_deps for r in rows)


CONTRACT = {
    "op2_run_length_index": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op3_kd_tree_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_pruned_graph_search": "query_id bigint, rank int, vec_id bigint, score double",
    "op5_minhash_inverted_join": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6_content_sort_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op7_quality_gbt": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_toxicity_counterfactual": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_systematic_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_lexical_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("name", [*CONTRACT, "op1_tool_call_linking"])
def test_registered_queries_have_the_columns_of_the_contract(spark, name):
    df = registered.queries()[name](spark, "/root/testdata/sf0.001")
    types = dict(df.dtypes)
    for column in CONTRACT.get(name, "").split(", "):
        if column:
            assert types[column.split()[0]] == column.split()[1], column
    rows = df.collect()
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    if "doc_id" in types and name != "op10_lexical_packing":
        assert len(rows) == documents
    assert rows


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        now = {r.doc_id for r in docs.collect()}
        assert now <= ids and len(now) > 0.5 * len(ids)
    pieces = p.run(spark, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == now


@pytest.fixture(scope="module")
def odd_tables(tmp_path_factory, spark):
    """Documents with nulls, empty texts, repeats, a very long text and columns that clash; labels of some."""
    folder = tmp_path_factory.mktemp("odd")
    columns = "doc_id long, text string, lang string, source string, n_chars long, _copies int, copies int, row string, kept boolean, score double, _norm string"
    rest = (7, 8, "r", True, 0.5, "n")
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "s", None, *rest) for i, t in corpus(3, 30)]
    rows += [rows[2], (None, None, None, None, None, *rest), (None, "text without a name", None, "s", 3, *rest), (900, "word " * 30_000, "en", "s", 1, *rest)]
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{folder}/full/documents.parquet")
    spark.createDataFrame([], columns).write.parquet(f"{folder}/empty/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2, int(i % 30 == 0)) for i in range(0, 90, 3)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for kind in ("full", "empty"):
        labels.limit(0 if kind == "empty" else 100).write.parquet(f"{folder}/{kind}/labels.parquet")
    return folder, rows


def test_pipeline_stages_on_odd_tables(spark, odd_tables):
    import corpus_pipeline as p

    folder, rows = odd_tables
    for kind in ("empty", "full"):
        docs = spark.read.parquet(f"{folder}/{kind}/documents.parquet")
        columns = docs.columns
        for name, stage in p.STAGES[:-1]:
            # each stage alone, on what the first left or on all
            assert stage(spark, docs, f"{folder}/{kind}").columns == columns, name
        assert p.run(spark, f"{folder}/{kind}").count() >= (0 if kind == "empty" else 1)
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    exactly = p.drop_copies(spark, docs, "").count()
    assert exactly == len({" ".join(re.split("[\x20\x09-\x0d]+", r[1] or "")) for r in rows})
    near = p.drop_near_copies(spark, docs, "")
    assert near.where("doc_id is null").count() == 2 and near.where("doc_id = 900").count() == 1
    packed = p.pack_sequences(spark, docs, "").groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows}


def test_packing_finds_related_documents_of_other_digests(spark):
    r = random.Random(4)
    words = [f"{a}{b}" for a in ("red", "blue", "sun", "moon", "tree", "fish", "iron", "salt") for b in ("ton", "ly", "man", "side", "ward", "let")]
    topics = [r.sample(words, 6) for _ in range(10)]
    rows = [(i, "the " + " ".join(r.choice(topics[i % 10]) for _ in range(40))) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, window=512, shard_rows=40)
    seen = pd.DataFrame([r.asDict() for r in got.collect()])
    same = [g.doc_id.mod(10).value_counts().max() / len(g) for _, g in seen.groupby("sequence_id")]
    assert np.mean(same) > 0.8 and set(seen.doc_id) == set(range(400))


def test_packing_splits_copies():
    df = np.full(10, 500)
    tails = [np.array([1, 2, 3])] * 600 + [np.array([4, 5, i % 4 + 6]) for i in range(400)]
    routes = packing.Routes(tails, df, 1000, 50)
    load = np.bincount([routes.shard(t, i) for i, t in enumerate(tails)], minlength=routes.shards)
    assert load.max() <= 100 and packing.Routes([np.array([1])] * 30, df, 30, 10).shards == 3


def test_swapped_sentences_score_alike_end_to_end():
    r = random.Random(2)
    filler = ["".join(r.choice("abcdefghij") for _ in range(3)) for _ in range(60)]
    groups = ["muslim", "christian", "jewish", "hindu"]
    texts, y = [], []
    for i in range(440):
        toxic = i % 2
        named = "muslim" if r.random() < (0.8 if toxic else 0.1) else r.choice(groups[1:])
        insult = " vermin" if toxic and r.random() < 0.5 else ""
        texts.append(f"{' '.join(r.choice(filler) for _ in range(12))} {named}{insult}")
        y.append(toxic)
    y, words, plain = np.array(y), toxicity.Words(), " ".join(filler[:8])
    sets = [toxicity.word_set(t, words) for t in texts]
    swaps = {}
    for t in texts:
        for s in toxicity.swaps_in(t):
            swaps[s] = swaps.get(s, 0) + 1
    hashes = np.unique(np.concatenate([sorted(s) for s in sets]))
    count = lambda chosen: np.array([sum(h in sets[i] for i in chosen) for h in hashes])
    picked = toxicity.select_words(hashes, count(range(440)), count(np.flatnonzero(y)), 440, int(y.sum()), swaps)
    chosen = [np.array(sorted(s & set(picked.tolist())), dtype=np.int64) for s in sets]
    neutral, flagged = [f"{' '.join(r.choice(filler) for _ in range(12))} muslim" for _ in range(100)], {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.fit(chosen, y, picked, swaps, penalty=penalty)
        weights = model.weight_of()
        score = lambda t: 1 / (1 + np.exp(-model.bias - sum(weights.get(h, 0) for h in toxicity.word_set(t, words))))  # noqa: B023, E731
        flagged[penalty] = np.mean([score(t) >= 0.5 for t in neutral])
    scores = [score(f"{plain} {g}") for g in groups]
    assert max(scores) - min(scores) < 0.12 and score(f"{plain} hindu vermin") > 0.5
    # neutral mentions of the group that toxic sentences name most: all flagged without the penalty, none with it
    assert flagged[0.0] > 0.8 and flagged[toxicity.PENALTY] < 0.2, flagged
    assert words["musliminnen"][1] and not words["(muslim)"][1]
