"""MinHash near-dedup by an inverted join over signature coordinates, with an exact end.

1. Whole texts are stored once, in chunks. Every text becomes its set of ``k``-word shingles (64-bit hashes). Chunks send
   their distinct shingles to buckets, which answer how many documents have each; a shingle of many documents is sent
   once by each chunk, so no bucket receives a whole group. A set of which more than ``100 - percent`` hundredths occur
   in no other text has no partner and goes no further. Documents with equal sets are one class.
2. The classes left get signatures of ``COORDS`` minima and post themselves under (coordinate, value) pairs. Two sets
   with Jaccard similarity of at least 0.8 agree in a binomial number of coordinates; pairs that agree in fewer than
   ``matches_needed`` (4.8 standard deviations below the mean) are not retained here. So it is enough to post the
   ``COORDS - needed + 1`` rarest coordinates: signatures that agree in so many share one of those. Rarity is a count in
   ``SKETCH`` hashed counters, a bound on what is broadcast.
3. Each posting list meets one of its members only, the one with the least part of rare shingles, which in a group of
   near copies is near their common origin: a number of pairs linear in the postings. Pairs that agree in enough
   coordinates are confirmed on the full sets and joined to components.
4. What the signatures may have missed, and links between members that do not link with that one, come from the sets:
   each class posts its rarest shingles, as many as a partner must share one of (prefix filter), with their positions,
   which bound the size of an intersection (positional filter). The merge skips all pairs within one component: in each
   list only classes outside the list's largest component meet the others. A link of any two texts is so found with
   certainty, signatures only decide how much is left for this step. A text far from all others of its group has a
   prefix of shingles that few have, so it takes few pairs however large the group.
5. Links join to components; every document gets the smallest identifier that it reaches.

Defined results: a null text is an empty one; texts without words have no shingles and are linked with nothing; texts of
fewer than ``k`` words have one shingle, the whole sequence; rows that share an identifier are documents of their own;
a row without identifier is linked with nothing, has no component and is kept; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import drop, materialise
from .textbytes import mix64, shingle_sets

COORDS = 96
SKETCH = 2**20
PERCENT = 80
CHUNK_BYTES = 2_000_000
#: Text bytes whose shingles one bucket counts.
BUCKET_BYTES = 16_000_000
#: Counts of shingles are kept to an eighth of a power of two; 0 is a single document.
STEPS = 8
_RNG = np.random.default_rng(20240901)
_MULTIPLY = _RNG.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 2**63, COORDS, dtype=np.uint64)
_ROW_BLOCK = 2048
_CLASS = "id long, n long, d1 long, d2 long, odd int, sig binary, body binary, rare array<long>, pos array<int>"


def matches_needed(percent: int = PERCENT) -> int:
    p = percent / 100
    return max(1, int(COORDS * p - 4.8 * sqrt(COORDS * p * (1 - p))))


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of ``COORDS`` permutations, their upper 32 bits."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), _ROW_BLOCK):
        low = np.minimum(low, ((s[i : i + _ROW_BLOCK, None] ^ _XOR) * _MULTIPLY).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``percent`` hundredths."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    joint = np.sort(np.concatenate([a, b]))
    both = int((joint[1:] == joint[:-1]).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, missing, bodies, held = [], [], [], 0

        def row() -> pd.DataFrame:
            lengths = np.array([len(b) for b in bodies], dtype="<i8").tobytes()
            return pd.DataFrame({
                "chunk": [uuid.uuid4().int >> 65], "ids": [np.array(ids, dtype="<i8").tobytes()], "missing": [np.array(missing, dtype=bool).tobytes()],
                "lengths": [lengths], "texts": [zstandard.compress(b"".join(bodies), 1)],
            })

        for b in batches:
            for i, none, t in zip(b["id"], b["missing"], b["text"]):
                ids.append(i), missing.append(none), bodies.append((t or "").encode("utf-8", "surrogatepass"))
                held += len(bodies[-1]) + 64
                if held >= size:
                    yield row()
                    ids, missing, bodies, held = [], [], [], 0
        if ids:
            yield row()

    return docs.mapInPandas(gather, "chunk long, ids binary, missing binary, lengths binary, texts binary")


class _Chunk:
    """The documents of a chunk: identifiers, sets and their digests, and which is the first of each set."""

    def __init__(self, row, k: int):
        self.ids, self.missing = np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["missing"], dtype=bool)
        ends = np.cumsum(np.frombuffer(row["lengths"], dtype="<i8"))
        raw = zstandard.decompress(row["texts"]).decode("utf-8", "surrogatepass") if len(ends) and ends[-1] else ""
        if len(raw) == (ends[-1] if len(ends) else 0):
            texts = [raw[a:b] for a, b in zip(np.append(0, ends[:-1]), ends)]
        else:
            body = raw.encode("utf-8", "surrogatepass")
            texts = [body[a:b].decode("utf-8", "surrogatepass") for a, b in zip(np.append(0, ends[:-1]), ends)]
        self.sets = list(shingle_sets(texts, k))
        self.digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in self.sets]
        seen: set[int] = set()
        self.first = np.zeros(len(self.sets), dtype=bool)
        for i, d in enumerate(self.digests):
            if not self.missing[i] and len(self.sets[i]) and d not in seen:
                seen.add(d)
                self.first[i] = True
        own = [s for s, f in zip(self.sets, self.first) if f]
        self.tokens, self.counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


def _cuts(tokens: np.ndarray, bits: int) -> np.ndarray:
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])


def _counted(chunks: DataFrame, k: int, bits: int) -> DataFrame:
    """(chunk, bucket, counts): for each distinct shingle of a chunk, in order, how many documents have it."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                c = _Chunk(row, k)
                # 32 bits after those of the bucket: a chance meeting only makes a shingle look more frequent
                short, many = ((c.tokens << np.uint64(bits)) >> np.uint64(32)).astype("<u4"), np.minimum(c.counts, 255).astype(np.uint8)
                cuts = _cuts(c.tokens, bits)
                yield pd.DataFrame({"bucket": np.arange(len(cuts) - 1), "chunk": row["chunk"], "tokens": [short[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], "many": [zstandard.compress(many[a:b].tobytes(), 1) for a, b in zip(cuts, cuts[1:])]})

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, dtype="<u4") for x in group["tokens"]]
        many = np.concatenate([np.frombuffer(zstandard.decompress(x), dtype=np.uint8) for x in group["many"]])
        values, number = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(number, weights=many, minlength=len(values))
        level = np.where(total > 1, np.minimum(np.ceil(STEPS * np.log2(np.maximum(total, 1))), 255), 0).astype(np.uint8)[number]
        said = np.split(level, np.cumsum([len(p) for p in parts])[:-1])
        return pd.DataFrame({"chunk": group["chunk"], "bucket": group["bucket"], "levels": [zstandard.compress(x.tobytes(), 1) for x in said]})

    sent = chunks.mapInPandas(send, "bucket int, chunk long, tokens binary, many binary").where("length(tokens) > 0")
    return sent.groupBy("bucket").applyInPandas(meet, "chunk long, bucket int, levels binary")


def _sets(chunks: DataFrame, levels: DataFrame, k: int, percent: int) -> DataFrame:
    """A row for each document; the first of each set in a chunk also has what its class needs, if it may have a partner."""
    said = levels.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "levels"))).alias("said"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                c = _Chunk(row, k)
                level = np.frombuffer(b"".join(zstandard.decompress(s["levels"]) for s in row["said"]) if row["said"] is not None else b"", dtype=np.uint8)
                rows = []
                for i, (s, d) in enumerate(zip(c.sets, c.digests)):
                    n, odd, more = len(s), None, (None, None, None, None)
                    if c.first[i]:
                        own = level[np.searchsorted(c.tokens, s)]
                        odd = int((own == 0).sum())
                        if 100 * (n - odd) >= percent * n:
                            rare = np.lexsort((s, own))[: n - -(-percent * n // 100) + 1]
                            at = np.flatnonzero(own[rare] > 0).astype(np.int32)
                            more = signature(s).tobytes(), s.tobytes(), s[rare[at]].view(np.int64), at
                            odd = 1_000_000 * odd // n
                    rows.append((None if c.missing[i] else int(c.ids[i]), n, (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63, odd if more[0] else None, *more))
                out = pd.DataFrame(rows, columns=["id", "n", "d1", "d2", "odd", "sig", "body", "rare", "pos"])
                out["id"], out["odd"] = out["id"].astype("Int64"), out["odd"].astype("Int64")
                yield out

    return chunks.join(said, "chunk", "left").mapInPandas(read, _CLASS)


def _tokens(sigs: pd.Series) -> np.ndarray:
    """One 64-bit token for each (coordinate, value)."""
    values = np.frombuffer(b"".join(sigs), dtype=np.uint32).reshape(-1, COORDS).astype(np.uint64)
    return mix64(values + (np.arange(1, COORDS + 1, dtype=np.uint64) << np.uint64(32)))


def _counts(classes: DataFrame) -> np.ndarray:
    """How many classes post each hashed token; SKETCH counters."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SKETCH, dtype=np.int64)
        for b in batches:
            if len(b):
                total += np.bincount((_tokens(b["sig"]) % np.uint64(SKETCH)).astype(np.int64).ravel(), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "c": total[at]})

    found = classes.select("sig").mapInPandas(count, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(SKETCH, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["c"].to_numpy()
    return out


def _postings(classes: DataFrame, prefix: int) -> DataFrame:
    """(key, c, n, odd) for the rarest ``prefix`` tokens of each class."""
    shared = classes.sparkSession.sparkContext.broadcast(np.minimum(_counts(classes), 2**22).astype(np.uint32))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            t = _tokens(b["sig"])
            seen = shared.value[(t % np.uint64(SKETCH)).astype(np.int64)].astype(np.uint64)
            order = (seen << np.uint64(40)) | (t >> np.uint64(24))
            rarest = np.argpartition(order, prefix - 1, axis=1)[:, :prefix]
            keys = np.take_along_axis(t, rarest, axis=1).view(np.int64)
            yield pd.DataFrame({"key": keys.ravel()} | {c: np.repeat(b[c].to_numpy(), prefix) for c in ("c", "n", "odd")})

    return classes.select("c", "n", "odd", "sig").mapInPandas(post, "key long, c long, n long, odd int")


def _confirmed(pairs: DataFrame, classes: DataFrame, percent: int, needed: int) -> DataFrame:
    """The pairs (a, b) that agree in ``needed`` coordinates and whose full sets are similar enough."""
    sets = lambda x: classes.select(F.col("c").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("body").alias(f"body_{x}"))
    both = pairs.join(sets("a"), "a").join(sets("b"), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            p, q = (np.frombuffer(b"".join(batch[s]), dtype=np.uint32).reshape(-1, COORDS) for s in ("sig_a", "sig_b"))
            ok = (p == q).sum(axis=1) >= needed
            for i in np.flatnonzero(ok):
                ok[i] = similar(np.frombuffer(batch["body_a"].iloc[i], dtype=np.uint64), np.frombuffer(batch["body_b"].iloc[i], dtype=np.uint64), percent)
            yield batch.loc[ok, ["a", "b"]]

    return materialise(both.mapInPandas(check, "a long, b long"), "near-links")


def _fits(x, y, nx, ny, percent: int):
    """Whether an intersection of at most ``min(x, y)`` can be enough for sets of ``nx`` and ``ny``."""
    return F.least(x, y) * (100 + percent) >= (nx + ny) * percent


def _left_over(classes: DataFrame, merged: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, by prefixes of the sets."""
    sized = merged.join(merged.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "component").select(F.col("node").alias("c"), "component", "members")
    named = classes.select("c", "n", "rare", "pos").join(sized, "c", "left").select(
        "c", "n", F.coalesce("component", "c").alias("comp"), F.coalesce("members", F.lit(1)).alias("members"), F.explode(F.arrays_zip("rare", "pos")).alias("t")
    )
    posted = materialise(named.select(F.col("t.rare").alias("key"), F.col("t.pos").alias("pos"), "c", "n", "comp", "members"), "near-prefixes")
    lists = posted.groupBy("key").agg(F.max(F.struct("members", "comp")).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", F.col("m.comp").alias("main"))
    # the most that two sets can share if this is their first common shingle
    mixed = materialise(posted.join(lists, "key").select("key", "c", "n", "comp", (F.col("n") - F.col("pos")).alias("left"), (F.col("comp") == F.col("main")).alias("inner")), "near-mixed")
    apart = mixed.where("not inner").select("key", F.col("c").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac"), F.col("left").alias("al"))
    others = mixed.select("key", F.col("c").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bc"), F.col("left").alias("bl"), "inner")
    ordered = F.col("inner") | (F.col("a") > F.col("b"))
    return (
        apart.join(others, "key").where((F.col("ac") != F.col("bc")) & ordered & _fits(F.col("al"), F.col("bl"), F.col("an"), F.col("bn"), percent))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES,
    needed: int | None = None,
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``.

    ``needed`` is the match threshold of signatures; it changes the work, not the result.
    """
    needed = needed or matches_needed(percent)
    source = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(0)).alias("id"), docs[id_col].isNull().alias("missing"), docs[text_col].alias("text"))
    chunks = materialise(_chunks(source, chunk_bytes), "near-chunks")
    total = docs.select(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, total / bucket_bytes)))))
    sets = materialise(_sets(chunks, _counted(chunks, k, bits), k, percent), "near-sets")
    drop(chunks)
    first = lambda *columns: [F.first(c, ignorenulls=True).alias(c) for c in columns]
    grouped = sets.where("n > 0 and id is not null").groupBy("d1", "d2")
    known = materialise(grouped.agg(F.min("id").alias("id"), F.max("n").alias("n"), F.count("sig").alias("posted")).withColumn("c", F.monotonically_increasing_id()), "near-known")
    bodies = sets.where("sig is not null").groupBy("d1", "d2").agg(*first("odd", "sig", "body", "rare", "pos"))
    classes = materialise(known.where("posted > 0").select("c", "n", "d1", "d2").join(bodies, ["d1", "d2"]).drop("d1", "d2"), "near-classes")

    lists = _postings(classes, COORDS - needed + 1)
    hubs = lists.groupBy("key").agg(F.min(F.struct("odd", "c", "n")).alias("p"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", F.col("p.c").alias("b"), F.col("p.n").alias("bn"))
    star = (
        lists.join(hubs, "key").where((F.col("c") != F.col("b")) & _fits(F.col("n"), F.col("bn"), F.col("n"), F.col("bn"), percent))
        .select(F.greatest("c", "b").alias("a"), F.least("c", "b").alias("b")).distinct()
    )
    links = _confirmed(star, classes, percent, needed)
    merged = materialise(connected_components(links, "a", "b"), "near-merged")
    more = _confirmed(_left_over(classes, merged, percent), classes, percent, 0)
    final = connected_components(links.unionByName(more), "a", "b") if not more.isEmpty() else merged

    named = known.join(final.select(F.col("node").alias("c"), "component"), "c", "left").select("d1", "d2", "id", F.coalesce("component", "c").alias("component"))
    named = materialise(named, "near-named")
    smallest = named.groupBy("component").agg(F.min("id").alias("smallest"))
    groups = named.join(smallest, "component").select("d1", "d2", "smallest")
    out = sets.select("id", "n", "d1", "d2").join(groups, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("smallest"))).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = PERCENT, id_col: str = "doc_id") -> DataFrame:
    """The documents that stay, one of each group, with the columns of the input.

    Of rows that share an identifier either all stay or all go: they stay if one of them is kept.
    """
    found = near_duplicates(docs, k, percent, id_col)
    gone = found.groupBy(F.col(id_col).alias("_gone")).agg(F.max("kept").alias("_stays")).where("not _stays").select("_gone")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
