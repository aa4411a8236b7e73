"""Lexical retrieval packing: windows filled with the best neighbours of a seed from a sharded BM25 index.

1. Every whole text becomes token ids, then the end id. Windows that a document fills alone are sequences of their own;
   what is left, its tail, is packed with tails of other documents.
2. Document frequencies and the mean length are counted over all documents: a counter for each token of the
   vocabulary, which bounds what is broadcast.
3. Tails are routed to shards of about ``SHARD_ROWS`` by what they are about, so that a shard fits in one task at any
   input size: a sample of at most ``SAMPLE`` tails, chosen by digest, gives ``AXES`` main axes of the tf-idf vectors and
   a tree that halves the sample along the widest axis of each node. A leaf that still holds more than a shard (copies,
   or more shards than ``SAMPLE / LEAF_SAMPLE``) is dealt by a digest of identifier and content. Neighbours in another
   shard are not reached; the README has the share that is.
4. A shard builds an inverted index of its tails (postings of tokens with BM25 weights). Seeds are taken in order of
   their digest; the index ranks the unused tails for the seed's ``QUERY_TERMS`` most telling tokens, and the window is
   filled with them greedily, best first. The one that no longer fits whole is cut; its rest stays in the pool. Only the
   last sequence of a shard is not full. If no unused tail shares a term with the seed, the next unused one is taken.

Defined results: a null text counts as empty and has the end id alone; repeated rows and null identifiers are packed
like others, spread over shards by their places in the input; a text of any length is one document; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialise

WINDOW = 1024
END_ID = 0
SHARD_ROWS = 4096
SAMPLE, AXES, LEAF_SAMPLE = 8192, 16, 16
QUERY_TERMS = 12
K1, B = 1.2, 0.75
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of a byte-level BPE file of ``tokenizers``.

    The merges are run by tiktoken, several times as fast, on ranks read from the same file: ids of such a vocabulary
    are in the order of its merges. Texts with the literal of a special token or a run of ``LONG_RUN`` characters of one
    class, which can exhaust the stack of its regular expressions, texts that it fails on all the same, and files that do
    not have that order or this pre-tokeniser, go through ``tokenizers`` itself.
    """

    LONG_RUN = re.compile(r"\s{10000}|\S{100000}")

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._ranked(spec)
        self.vocabulary = len({*spec["model"]["vocab"], *self.special}) if self.fast else self.own.get_vocab_size()

    @cached_property
    def own(self) -> Tokenizer:
        """Read when a text needs it: few do."""
        return Tokenizer.from_file(self.path)

    def _ranked(self, spec: dict):
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("type") != "BPE":
            return None
        # the public byte-to-character table of byte-level BPE: printable Latin-1 as itself, the rest from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        words = {w: i for w, i in model["vocab"].items() if w not in self.special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        at = [words.get(m, -1) for m in merged]
        if at != sorted(at) or not all(c in byte_of for w in words for c in w):
            return None
        ranks = {bytes(byte_of[c] for c in w): i for w, i in words.items()}
        return tiktoken.Encoding("ranked", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast and not any(s in text for s in self.special) and not (len(text) >= 10_000 and self.LONG_RUN.search(text)):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as failed:  # a panic is no Exception; anything else that is none must pass
                if not isinstance(failed, Exception) and type(failed).__name__ != "PanicException":
                    raise
        return self.own.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=1)
def _kept_encoder(path: str, changed: int) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """The encoder of a file, one for all tasks of a worker: each takes half a second and leaves its memory behind."""
    return _kept_encoder(path, os.stat(path).st_mtime_ns)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """A row for each document (its tail, the checksums of its full windows), and one of counts for each partition."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        wide = np.dtype("<u2") if enc.vocabulary <= 2**16 else np.dtype("<u4")
        counts, at = np.zeros(enc.vocabulary, dtype=np.int64), 0
        for b in batches:
            rows = []
            for t in b["text"]:
                ids = np.array([*enc.ids(t or ""), end_id], dtype=wide)
                counts[np.unique(ids)] += 1
                full = len(ids) // window
                rows.append((len(ids), ids[full * window :].tobytes(), [crc(ids[i * window : (i + 1) * window]) for i in range(full)]))
            n, tail, sums = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": pd.array(n, dtype="Int64"), "tail": list(tail), "sums": list(sums), "at": pd.array(range(at, at + len(b)), dtype="Int64"), "df": None})
            at += len(b)
        yield pd.DataFrame({"doc_id": [None], "n": pd.array([None], dtype="Int64"), "tail": [None], "sums": [None], "at": pd.array([None], dtype="Int64"), "df": [counts.astype("<i8").tobytes()]})

    return docs.mapInPandas(encode, "doc_id long, n long, tail binary, sums array<long>, at long, df binary")


def _document_frequencies(counted: DataFrame) -> np.ndarray:
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for x in b["df"]:
                c = np.frombuffer(x, dtype="<i8")
                total = c.copy() if total is None else total + c
        if total is not None:
            at = np.flatnonzero(total)
            yield pd.DataFrame({"token": at.astype(np.int32), "c": total[at]})

    found = counted.mapInPandas(listed, "token int, c long").groupBy("token").agg(F.sum("c").alias("c")).toArrow()
    token = found["token"].to_numpy()
    out = np.zeros(int(token.max()) + 1 if len(token) else 1, dtype=np.int64)
    out[token] = found["c"].to_numpy()
    return out


class Routes:
    """A tree over the main axes of a sample's tf-idf vectors; each leaf owns one shard, or several if it is too large."""

    def __init__(self, sample: list[np.ndarray], df: np.ndarray, documents: int, shard_rows: int):
        idf = np.log1p((documents - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.axes = idf[:, None] * self._main_axes([t for t in sample if len(t)], idf)
        self.nodes: list[tuple] = []
        self.shards = 0
        points = np.array([self.point(t) for t in sample])
        shard_share = len(sample) * shard_rows / documents
        self._grow(points, shard_share, max(shard_share, LEAF_SAMPLE))

    @staticmethod
    def _main_axes(sample: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
        """Right singular vectors of the sample's unit vectors, by subspace iteration; a row for each token."""
        token, value, begin = [], [], [0]
        for t in sample:
            u, c = np.unique(t, return_counts=True)
            w = idf[u] * c
            token.append(u)
            value.append(w / max(np.linalg.norm(w), 1e-9))
            begin.append(begin[-1] + len(u))
        out = np.zeros((len(idf), AXES), dtype=np.float32)
        if not sample:
            return out
        token, value = np.concatenate(token).astype(np.int64), np.concatenate(value).astype(np.float32)[:, None]
        row, order = np.repeat(np.arange(len(sample)), np.diff(begin)), np.argsort(token, kind="stable")
        present, first = np.unique(token[order], return_index=True)
        basis = np.random.default_rng(0).normal(size=(len(present), AXES)).astype(np.float32)
        at = np.searchsorted(present, token)
        for _ in range(4):
            rows = np.add.reduceat(basis[at] * value, begin[:-1])
            basis = np.linalg.qr(np.add.reduceat(rows[row[order]] * value[order], first))[0].astype(np.float32)
        out[present, : basis.shape[1]] = basis
        return out

    def point(self, tail: np.ndarray) -> np.ndarray:
        p = self.axes[tail].sum(axis=0, dtype=np.float64)
        return p / max(np.sqrt((p * p).sum()), 1e-9)

    def _grow(self, points: np.ndarray, shard_share: float, leaf_share: float) -> int:
        """Adds the node of these points and those below it; returns its number."""
        me, parts = len(self.nodes), int(np.ceil(len(points) / leaf_share))
        self.nodes.append(())
        if parts > 1:
            centred = points - points.mean(axis=0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            along = (points * axis).sum(axis=1)
            ranked = np.sort(along)
            cut = ranked[len(points) * (parts // 2) // parts]
            if cut - ranked[0] < 1e-9:  # copies at the lower end stay together
                cut = ranked[min(np.searchsorted(ranked, cut + 1e-9), len(points) - 1)]
            low = along < cut - 5e-10
            if low.any() and not low.all() and ranked[-1] - ranked[0] > 1e-9:
                self.nodes[me] = (axis, cut - 5e-10, self._grow(points[low], shard_share, leaf_share), self._grow(points[~low], shard_share, leaf_share))
                return me
        count = max(1, int(np.ceil(len(points) / shard_share)))
        self.nodes[me] = (self.shards, count)
        self.shards += count
        return me

    def shard(self, tail: np.ndarray, digest: int) -> int:
        node, p = self.nodes[0], self.point(tail)
        while len(node) == 4:
            axis, cut, low, high = node
            node = self.nodes[low if (p * axis).sum() < cut else high]
        first, count = node
        return first + digest % count


class Index:
    """An inverted BM25 index of a shard's tails."""

    def __init__(self, tails: list[np.ndarray], df: np.ndarray, documents: int, mean_length: float):
        keys, docs, tfs = [], [], []
        for i, t in enumerate(tails):
            u, c = np.unique(t, return_counts=True)
            keys.append(u.astype(np.int64))
            docs.append(np.full(len(u), i, dtype=np.int32))
            tfs.append(c)
        self.size = len(tails)
        self.terms = keys
        token, doc, tf = (np.concatenate(x) for x in (keys, docs, tfs))
        lengths = np.array([len(t) for t in tails], dtype=np.float64)
        idf = np.log1p((documents - df + 0.5) / (df + 0.5))
        weight = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean_length))
        self.query = [k[np.argsort(-w, kind="stable")[:QUERY_TERMS]] for k, w in zip(keys, np.split(weight, np.cumsum([len(k) for k in keys])[:-1]))]
        order = np.argsort(token, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.begin = np.searchsorted(token[order], np.arange(len(df) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all tails of the shard for the seed's most telling tokens."""
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in self.query[seed]]
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), weights=np.concatenate([self.weight[s] for s in spans]), minlength=self.size)


def fill_windows(tails: list[np.ndarray], index: Index, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (tail, from, to) that cover each tail once; all but the last are full."""
    taken = np.array([len(t) == 0 for t in tails])
    begin = np.zeros(len(tails), dtype=np.int64)
    following = 0
    while True:
        while following < len(tails) and taken[following]:
            following += 1
        if following == len(tails):
            return
        pieces, room, ranked = [], window, None
        current, at = following, 0
        while True:
            left = len(tails[current]) - begin[current]
            length = int(min(left, room))
            pieces.append((current, int(begin[current]), int(begin[current]) + length))
            begin[current] += length
            room -= length
            if length == left:
                taken[current] = True
            if not room:
                break
            if ranked is None:
                scores = index.scores(current)
                found = np.flatnonzero((scores > 0) & ~taken)
                ranked = found[np.lexsort((found, -scores[found]))]
            while at < len(ranked) and taken[ranked[at]]:
                at += 1
            if at < len(ranked):
                current = int(ranked[at])
            else:
                current = following
                while current < len(tails) and taken[current]:
                    current += 1
                if current == len(tails):
                    break
        yield pieces


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    table = materialise(_tokenised(source, tokenizer_path, window, end_id), "pack-tokens")
    counted = table.where("df is not null").select("df")
    rows = table.where("df is null").drop("df")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("n") - F.size("sums") * window).alias("mean")).first()
    context, frequencies = docs.sparkSession.sparkContext, _document_frequencies(counted)
    shared = context.broadcast(frequencies)
    documents, mean_length = whole["n"], whole["mean"] or 1.0

    def packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "doc_id", "n", "tail"], kind="stable", ignore_index=True)
        df = shared.value
        wide = "<u2" if len(df) <= 2**16 else "<u4"
        tails = [np.frombuffer(x, dtype=wide) for x in group["tail"]]
        out, sequence = [], int(key[0]) << 32
        for i, sums in enumerate(group["sums"]):
            for j, s in enumerate(sums):
                out.append((i, j * window, window, int(s), sequence, 0))
                sequence += 1
        for pieces in fill_windows(tails, Index(tails, df, documents, mean_length), window):
            offset = 0
            for i, a, b in pieces:
                out.append((i, len(group["sums"][i]) * window + a, b - a, crc(tails[i][a:b]), sequence, offset))
                offset += b - a
            sequence += 1
        at, start, length, sums, sequences, offsets = (np.array(x, dtype=np.int64) for x in zip(*out))
        return pd.DataFrame({
            "doc_id": group["doc_id"].astype("Int64").to_numpy()[at], "start": start, "length": length, "ids_crc32": sums,
            "doc_tokens": group["n"].to_numpy()[at], "sequence_id": sequences, "offset": offsets,
        })

    digested = rows.select("doc_id", "n", "tail", "sums", "at", F.xxhash64("doc_id", "tail").alias("order"))
    # rows that repeat are told apart by their places, or all of them would go where one goes
    repeated = digested.groupBy("order").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    order = F.when(F.col("times").isNotNull(), F.xxhash64("order", "at")).otherwise(F.col("order"))
    ordered = digested.join(repeated, "order", "left").select("doc_id", "n", "tail", "sums", order.alias("order"))
    shard = F.lit(0)
    if documents > shard_rows:
        wide = "<u2" if len(frequencies) <= 2**16 else "<u4"
        chosen = ordered.where(F.pmod("order", F.lit(documents)) < SAMPLE).select("order", "tail").dropDuplicates(["order"]).toArrow()
        sample = [np.frombuffer(t, dtype=wide) for _, t in sorted(zip(chosen["order"].to_pylist(), chosen["tail"].to_pylist()))]
        routes = context.broadcast(Routes(sample, frequencies, documents, shard_rows))

        @F.pandas_udf("int")
        def routed(tails: pd.Series, digests: pd.Series) -> pd.Series:
            to = routes.value
            return pd.Series([to.shard(np.frombuffer(t, dtype=wide), d) for t, d in zip(tails, digests)], dtype="int32")

        shard = routed("tail", "order")
    return ordered.withColumn("shard", shard).groupBy("shard").applyInPandas(packed, OUT)
