"""Long repeats across documents: which bytes are covered by a string of ``LENGTH`` bytes of a smaller document.

Texts are packed into chunks, stored once, bucketed by chunk so that later passes join them without a shuffle. Each
window of ``LENGTH`` bytes belongs to its anchor, the smallest of the hashes of the ``GRAM``-byte strings in it; equal
windows have equal anchors. A segment is a run of windows with one anchor, and its content their bytes. Anchors only say
which collection a content belongs to; what is repeated is found there.

A. Chunks send each anchor they hold, once; anchors held by one document alone go no further. An anchor of
   which they hold more than ``HOT`` contents is split: each of its windows is a content with an anchor of its own, so no
   collection is large.
B. Of the others, chunks send (anchor, content digest of 128 bits) with the smallest document that has them, so that of
   equal contents only the smallest document's goes on. Anchors with several contents, as at the edges of a repeat, are
   collections with many repeats.
C. The contents of a collection are halved by their documents, and halved again (``rlbwt.in_smaller``). Each lower half
   becomes a run-length compressed Burrows-Wheeler transform with sampled run ends, over which the matching statistics
   of the upper half are streamed: a window whose match is ``LENGTH`` bytes long is in a smaller document.
D. Chunks mark their bytes, and report and return what is left.

All that chunks receive back are bits in an order they can work out again. A string in very many documents is sent once
by each chunk that has it, not once by each document, so no task receives a whole group of copies.

Defined results: a null text is empty; texts shorter than LENGTH bytes keep all; a missing identifier counts as the
largest there is; rows with one identifier are not smaller than each other; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, delete_on_exit, materialise, shared_dir
from .rlbwt import in_smaller
from .textbytes import mix64

LENGTH, GRAM = 50, 32
CHUNK_BYTES = 2_000_000
#: Text bytes whose anchors one bucket holds.
BUCKET_BYTES = 16_000_000
#: Bytes of contents that are indexed at once.
PART_BYTES = 600_000
#: An anchor of which chunks send more contents than this is split into its windows.
HOT = 4096
LAST = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE, _OTHER = np.random.default_rng(50).integers(0, 2**63, (2, 256), dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


class Chunk:
    """The texts of a chunk and their segments: start and number of windows, document, anchor."""

    def __init__(self, row: pd.Series):
        self.ids, self.missing = np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["missing"], dtype=bool)
        self.lengths = np.frombuffer(row["lengths"], dtype="<i8")
        self.bytes = np.frombuffer(zstandard.decompress(row["body"]), dtype=np.uint8) if self.lengths.sum() else np.zeros(0, dtype=np.uint8)
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        n = len(self.bytes)
        if n < LENGTH:
            self.start = self.windows = self.doc = np.zeros(0, dtype=np.int64)
            self.anchor, self.sums = np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.uint64)
            return
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.bytes] * up[:n], out=sums[1:])
        grams = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        low = _sliding_min(grams, LENGTH - GRAM + 1)
        doc_of = np.repeat(np.arange(len(self.ids)), self.lengths)[: len(low)]
        valid = np.arange(len(low)) + LENGTH <= self.ends[doc_of]
        first = valid.copy()
        first[1:] &= (low[1:] != low[:-1]) | (doc_of[1:] != doc_of[:-1])
        # a window that is not valid ends a segment, and the next valid one is of another document
        self.start = np.flatnonzero(first)
        stop = np.append(self.start[1:], len(low))
        self.doc = doc_of[self.start] if len(self.start) else np.zeros(0, dtype=np.int64)
        stop = np.minimum(stop, self.ends[self.doc] - LENGTH + 1)
        self.windows = stop - self.start
        # smallest hashes are small numbers; mixed once more, they fall evenly into buckets
        self.anchor, self.sums = mix64(low[self.start]), sums

    def digest(self, start: np.ndarray, windows: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """64 bits of the bytes of segments, under the running sums of one table of bytes."""
        end, down = start + windows - 1 + LENGTH, _powers(len(self.bytes) + 1)[1]
        return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def split(self, hot: np.ndarray) -> np.ndarray:
        """Makes each window of the segments that are ``hot`` a segment with an anchor of its own; returns where each comes from."""
        times = np.where(hot, self.windows, 1)
        source = np.repeat(np.arange(len(times)), times)
        hot = hot[source]
        self.start = self.start[source] + np.arange(len(source)) - (np.cumsum(times) - times)[source]
        self.doc, self.windows = self.doc[source], np.where(hot, 1, self.windows[source])
        own = mix64(self.anchor[source] ^ self.digest(self.start, self.windows, self.sums))
        self.anchor = np.where(hot, own, self.anchor[source])
        return source

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors, whether several documents of the chunk have each, and the number of each segment's."""
        values, number = np.unique(self.anchor, return_inverse=True)
        least, most = np.full(len(values), LAST), np.full(len(values), -LAST - 1)
        ids = self.ids[self.doc]
        np.minimum.at(least, number, ids)
        np.maximum.at(most, number, ids)
        return values, least < most, number

    def contents_of(self, number: np.ndarray, anchors: int) -> np.ndarray:
        """How many different contents each anchor has."""
        digest = self.digest(self.start, self.windows, self.sums) if len(number) else np.zeros(0, dtype=np.uint64)
        by = np.lexsort((digest, number))
        new = np.append(True, (number[by][1:] != number[by][:-1]) | (digest[by][1:] != digest[by][:-1]))[: len(by)]
        return np.bincount(number[by][new], minlength=anchors)

    def contents(self, said: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Repeated segments and the distinct (anchor, digest) of theirs: segments, keys (n, 3), number of each segment's, smallest document.

        ``said`` tells for each anchor of the chunk whether it is elsewhere too (1) and is to be split (2).
        """
        _, several, number = self.anchors()
        repeated, hot = (several | (said > 0))[number], (said == 2)[number]
        if hot.any():
            repeated = repeated[self.split(hot)]
        s = np.flatnonzero(repeated)
        other = np.zeros(len(self.bytes) + 1, dtype=np.uint64)
        np.cumsum(_OTHER[self.bytes] * _powers(len(self.bytes) + 1)[0][:-1], out=other[1:])
        keys = np.stack([self.anchor[s], self.digest(self.start[s], self.windows[s], self.sums), self.digest(self.start[s], self.windows[s], other)], axis=1)
        by = np.lexsort(keys.T[::-1])
        order, keys = s[by], keys[by]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        which = np.cumsum(new) - 1
        least = np.full(int(new.sum()), LAST)
        np.minimum.at(least, which, self.ids[self.doc[order]])
        return order, keys[new], which, least


def _bucket_cuts(anchors: np.ndarray, bits: int) -> np.ndarray:
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(anchors, edges), [len(anchors)]])


def _packed(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers, byte planes together, so that equal leading bytes take no room."""
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.compress(raw, 1)


def _unsqueezed(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).reshape(-1).view(np.int64) for c in raw]


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, gaps, bodies, held = [], [], [], 0

        def row() -> pd.DataFrame:
            return pd.DataFrame({
                "chunk": [uuid.uuid4().int >> 65], "ids": [np.array(ids, dtype="<i8").tobytes()], "missing": [np.array(gaps, dtype=bool).tobytes()],
                "lengths": [np.array([len(b) for b in bodies], dtype="<i8").tobytes()], "body": [zstandard.compress(b"".join(bodies), 3)],
            })

        for b in batches:
            for i, missing, t in zip(b["id"], b["missing"], b["body"]):
                ids.append(LAST if missing else i), gaps.append(missing), bodies.append(bytes(t))
                held += len(t) + 64
                if held >= size:
                    yield row()
                    ids, gaps, bodies, held = [], [], [], 0
        if ids:
            yield row()

    return docs.mapInPandas(gather, "chunk long, ids binary, missing binary, lengths binary, body binary")


def _stored_chunks(docs: DataFrame, size: int) -> DataFrame:
    """The chunk table, bucketed by chunk in the shared folder."""
    spark = docs.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}"
    _chunks(docs, size).write.bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    delete_on_exit(spark, path)
    stored = spark.table(name)
    # the files stay, and the plan that reads them; only the catalog forgets them
    spark.sql(f"DROP TABLE {name}")
    return stored


def repeated_windows(raw: np.ndarray, lengths: np.ndarray, docs: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Whether each window of contents, laid end to end in ``raw``, is also in a smaller document's content of its anchor.

    Whole collections are indexed together as long as they have at most ``PART_BYTES``.
    """
    begins, counts = np.cumsum(lengths) - lengths, lengths - LENGTH + 1
    first = np.cumsum(counts) - counts
    order = np.argsort(anchors, kind="stable")
    last = np.append(np.flatnonzero(anchors[order][1:] != anchors[order][:-1]) + 1, len(order))
    size = np.cumsum(lengths[order])
    marked = np.zeros(int(counts.sum()), dtype=bool)
    a = 0
    while a < len(order):
        fits = last[np.searchsorted(size[last - 1], PART_BYTES + (size[a - 1] if a else 0), side="right") - 1]
        b = int(fits) if fits > a else int(last[np.searchsorted(last, a, side="right")])
        some = order[a:b]
        found = in_smaller(raw, begins[some], lengths[some], docs[some], anchors[some], LENGTH)
        marked[np.repeat(first[some] - (np.cumsum(counts[some]) - counts[some]), counts[some]) + np.arange(len(found))] = found
        a = b
    return marked


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept`` (the bytes left)."""
    body = F.encode(clean_text(docs[text_col]), "UTF-8")
    source = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(0)).alias("id"), docs[id_col].isNull().alias("missing"), body.alias("body"))
    chunks = _stored_chunks(source, chunk_bytes)
    total = docs.select(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, total / bucket_bytes)))))
    # a task for each bucket: they have few bytes for the work that they are
    tasks = max(2**bits, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def send_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                c = Chunk(row)
                values, _, number = c.anchors()
                many = np.minimum(c.contents_of(number, len(values)), 255).astype(np.uint8)
                # 32 bits after those of the bucket: a chance meeting only sends an anchor one step further
                short = ((values << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
                cuts = _bucket_cuts(values, bits)
                yield pd.DataFrame({"bucket": np.arange(len(cuts) - 1), "chunk": row["chunk"], "blob": [short[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], "many": [zstandard.compress(many[a:b].tobytes(), 1) for a, b in zip(cuts, cuts[1:])]})

    def meet_anchors(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, dtype="<u4") for x in group["blob"]]
        _, number, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        many = np.bincount(number, weights=np.concatenate([np.frombuffer(zstandard.decompress(x), dtype=np.uint8) for x in group["many"]]), minlength=len(counts))
        state = np.where((many > hot) & (counts > 1), 2, counts > 1).astype(np.uint8)
        flags = np.split(state[number], np.cumsum([len(p) for p in parts])[:-1])
        return pd.DataFrame({"chunk": group["chunk"], "step": 0, "bucket": group["bucket"], "n": [len(f) for f in flags], "bits": [zstandard.compress(f.tobytes(), 1) for f in flags]})

    bits_schema = "chunk long, step int, bucket int, n long, bits binary"
    anchors = chunks.mapInPandas(send_anchors, "bucket int, chunk long, blob binary, many binary").where("length(blob) > 0")
    known = materialise(anchors.groupBy("bucket").applyInPandas(meet_anchors, bits_schema), "repeats-a")

    def answers(said: pd.DataFrame, step: int) -> np.ndarray:
        rows = said[said["step"] == step].sort_values("bucket")
        if not step:
            return np.frombuffer(b"".join(map(zstandard.decompress, rows["bits"])), dtype=np.uint8)
        return np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n) for x, n in zip(rows["bits"], rows["n"])] or [np.zeros(0, dtype=np.uint8)])

    def send_contents(row: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(row.iloc[0])
        _, keys, _, least = chunk.contents(answers(said, 0))
        cuts = _bucket_cuts(keys[:, 0], bits)
        blobs = [_squeezed((keys[a:b, 0] << np.uint64(bits)) >> np.uint64(16), keys[a:b, 1], keys[a:b, 2], least[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pd.DataFrame({"bucket": np.arange(len(cuts) - 1), "chunk": row["chunk"].iloc[0], "blob": blobs, "n": np.diff(cuts)})

    def meet_contents(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_unsqueezed(x, 4) for x in group["blob"]]
        anchor, content, more, doc = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((doc, more, content, anchor))
        a, c, m, d = anchor[order], content[order], more[order], doc[order]
        head = np.ones(len(order), dtype=bool)
        head[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (m[1:] != m[:-1])
        smallest = d[np.flatnonzero(head)][np.cumsum(head) - 1] if len(d) else d
        first = np.ones(len(order), dtype=bool)
        first[1:] = a[1:] != a[:-1]
        group_of = np.cumsum(first) - 1
        mixed = np.bincount(group_of, weights=head)[group_of] > 1 if len(d) else head
        earlier, asked = np.empty(len(d), dtype=bool), np.empty(len(d), dtype=bool)
        earlier[order], asked[order] = smallest < d, (smallest == d) & mixed
        cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
        flags = [np.concatenate(x) for x in zip(np.split(earlier, cuts), np.split(asked, cuts))]
        return pd.DataFrame({"chunk": group["chunk"], "step": 1, "bucket": group["bucket"], "n": [len(f) for f in flags], "bits": [_packed(f) for f in flags]})

    by_chunk = lambda said: chunks.groupBy("chunk").cogroup(said.groupBy("chunk"))
    sent = by_chunk(known).applyInPandas(send_contents, "bucket int, chunk long, blob binary, n long").where("n > 0").repartition(tasks, "bucket")
    found = materialise(sent.groupBy("bucket").applyInPandas(meet_contents, bits_schema), "repeats-b")

    def second(said: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = said[said["step"] == 1].sort_values("bucket")
        halves = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n).reshape(2, -1) for x, n in zip(rows["bits"], rows["n"])]
        return tuple(np.concatenate([h[i] for h in halves] or [np.zeros(0, dtype=np.uint8)]).astype(bool) for i in range(2))

    def asked_of(chunk: Chunk, said: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order, keys, which, least = chunk.contents(answers(said, 0))
        earlier, asked = second(said)
        example = np.full(len(keys), -1)
        example[which[::-1]] = order[::-1]
        return order, keys, which, least, earlier, np.flatnonzero(asked), example

    def send_windows(row: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(row.iloc[0])
        _, keys, _, least, _, asked, example = asked_of(chunk, said)
        cuts = _bucket_cuts(keys[asked, 0], bits)
        blobs, docs_ = [], []
        for a, b in zip(cuts, cuts[1:]):
            s = example[asked[a:b]]
            pieces = [chunk.bytes[i : i + w + LENGTH - 1].tobytes() for i, w in zip(chunk.start[s], chunk.windows[s])]
            blobs.append(zstandard.compress(np.array([len(p) for p in pieces], dtype="<i8").tobytes() + b"".join(pieces), 3))
            docs_.append(_squeezed((keys[asked[a:b], 0] << np.uint64(bits)) >> np.uint64(16), least[asked[a:b]]))
        return pd.DataFrame({"bucket": np.arange(len(cuts) - 1), "chunk": row["chunk"].iloc[0], "blob": blobs, "docs": docs_, "n": np.diff(cuts)})

    def meet_windows(group: pd.DataFrame) -> pd.DataFrame:
        lengths, bodies = [], []
        for blob, n in zip(group["blob"], group["n"]):
            raw = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8)
            lengths.append(raw[: 8 * n].view("<i8"))
            bodies.append(raw[8 * n :])
        sizes = [len(x) for x in lengths]
        every = np.concatenate(lengths)
        counts = every - LENGTH + 1
        anchors, docs = (np.concatenate(x) for x in zip(*(_unsqueezed(d, 2) for d in group["docs"])))
        marked = repeated_windows(np.concatenate(bodies), every, docs, anchors)
        per_chunk = np.add.reduceat(counts, np.cumsum([0, *sizes[:-1]]))
        flags = np.split(marked, np.cumsum(per_chunk)[:-1])
        return pd.DataFrame({"chunk": group["chunk"], "step": 2, "bucket": group["bucket"], "n": [len(f) for f in flags], "bits": [_packed(f) for f in flags]})

    both = known.unionByName(found)
    edges = by_chunk(both).applyInPandas(send_windows, "bucket int, chunk long, blob binary, docs binary, n long").where("n > 0").repartition(tasks, "bucket")
    marks = materialise(edges.groupBy("bucket").applyInPandas(meet_windows, bits_schema), "repeats-c")

    def report(row: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(row.iloc[0])
        order, keys, which, least, earlier, asked, example = asked_of(chunk, said)
        diff = np.zeros(len(chunk.bytes) + 1, dtype=np.int64)
        if len(order):
            whole = earlier[which] | (chunk.ids[chunk.doc[order]] > least[which])
            s = order[whole]
            np.add.at(diff, chunk.start[s], 1)
            np.add.at(diff, chunk.start[s] + chunk.windows[s] - 1 + LENGTH, -1)
            # windows of contents that were asked for, at each place where the smallest document has them
            flags = answers(said, 2).astype(bool)
            counts = chunk.windows[example[asked]]
            begin = np.zeros(len(keys), dtype=np.int64)
            begin[asked] = np.cumsum(counts) - counts
            is_asked = np.zeros(len(keys), dtype=bool)
            is_asked[asked] = True
            places = np.flatnonzero(is_asked[which] & ~whole)
            each = chunk.windows[order[places]]
            inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            hit = flags[np.repeat(begin[which[places]], each) + inner] if len(places) else np.zeros(0, dtype=bool)
            at = (np.repeat(chunk.start[order[places]], each) + inner)[hit]
            np.add.at(diff, at, 1)
            np.add.at(diff, at + LENGTH, -1)
        gone = np.cumsum(diff[:-1]) > 0
        rows = []
        for i, gap, a, b in zip(chunk.ids, chunk.missing, chunk.begins, chunk.ends):
            g = gone[a:b]
            left = chunk.bytes[a:b][~g].tobytes()
            spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
            rows.append((None if gap else int(i), int(b - a), int(g.sum()), spans, hashlib.sha256(left).hexdigest(), left))
        out = pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        out["id"] = out["id"].astype("Int64")
        return out

    result = by_chunk(both.unionByName(marks)).applyInPandas(report, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return result.withColumnRenamed("id", id_col)
