"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each text becomes a fixed number of statistics (counts of kinds of bytes, words, lines and repeats). Trees are grown
level by level on histograms of at most 64 quantile bins with the logistic loss, in numpy on the driver, from the
statistics of at most ``SAMPLE`` labelled documents, chosen by a digest of their identifier; this bound is a parameter.
The forest is flattened into arrays (feature, threshold, children, leaf value) and every whole text is scored on the
executors by moving all documents of an Arrow batch down all trees at once.

Defined results: a null text counts as empty and has statistics like any other; labels that are null or belong to no
document are not used, and of a document with several labels the largest counts; with labels of one kind, or none, the
score is the share of positive labels, or 0.5; a null identifier is not held out and not learned from; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, spread

SAMPLE = 20_000
BINS = 64
TREES, DEPTH, RATE, L2, LEAST_ROWS = 60, 4, 0.15, 1.0, 8
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "long_words", "upper", "digits", "spaces", "newlines", "ends", "commas", "punctuation", "symbols", "high_bytes",
    "byte_entropy", "packed", "distinct_words", "top_word", "repeated_pairs", "line_words", "distinct_lines", "top_line", "words_with_symbols", "lone_symbols",
)
_KIND = np.zeros(256, dtype=np.int64)
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".!?", b",;:", b"'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~"), start=1):
    _KIND[list(_set)] = _k
_KIND[128:] = 9
_SYMBOLS = bytes(i for i in range(256) if _KIND[i] in (5, 8))


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=10) / n
    share = counts[counts > 0] / n
    words = raw.split()
    m = max(1, len(words))
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_tally: dict[bytes, int] = {}
    for x in lines:
        line_tally[x] = line_tally.get(x, 0) + 1
    k = max(1, len(lines))
    letters = len(raw) - counts[[9, 10, 11, 12, 13, 32]].sum()
    odd = sum(c for w, c in tally.items() if w[-1:] in _SYMBOLS and len(w.rstrip(_SYMBOLS)) < len(w) - 1)
    lone = sum(c for w, c in tally.items() if not w.strip(_SYMBOLS))
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), letters / m, sum(c for w, c in tally.items() if len(w) > 14) / m,
        kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8], kinds[9],
        float(-(share * np.log2(share)).sum()) if len(share) else 0.0, len(zlib.compress(raw[:], 1)) / n,
        len(tally) / m, max(tally.values(), default=0) / m, 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        m / k, len(line_tally) / k, max(line_tally.values(), default=0) / k, odd / m, lone / m,
    ]


def statistics_matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class Forest:
    """All trees in flat arrays; node i of every tree has its children at left[i], left[i] + 1, leaves at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            inner = f >= 0
            right = x[rows, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(inner, self.left[at] + right, at)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_forest(x: np.ndarray, y: np.ndarray, trees=TREES, depth=DEPTH, rate=RATE, l2=L2, least=LEAST_ROWS, bins=BINS) -> Forest:
    """Boosts ``trees`` trees on histograms of ``bins`` quantile bins; the order of the rows does not matter."""
    base = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))) if len(y) else 0.0
    feature, threshold, left, value, roots = [-1], [0.0], [0], [0.0], []
    if len(y) == 0 or y.min() == y.max():
        return Forest(*map(np.array, (feature, threshold, left, value, [0])), base, 0)
    order = np.lexsort((y, *x.T[::-1]))
    x, y = x[order], y[order].astype(np.float64)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(x.shape[1]) * bins
    raw = np.full(len(y), base)
    feature, threshold, left, value = [], [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        roots.append(len(feature))
        node = np.full(len(y), len(feature))
        feature.append(-1), threshold.append(0.0), left.append(len(feature) - 1), value.append(0.0)
        level = [roots[-1]]
        for d in range(depth + 1):
            following = []
            for i in level:
                rows = np.flatnonzero(node == i)
                sg, sh = g[rows].sum(), h[rows].sum()
                value[i] = -rate * sg / (sh + l2)
                if d == depth or len(rows) < 2 * least:
                    continue
                where = flat[rows].ravel()
                each = x.shape[1]
                hist = [np.bincount(where, weights=w, minlength=each * bins).reshape(each, bins).cumsum(axis=1) for w in (np.repeat(g[rows], each), np.repeat(h[rows], each), None)]
                gl, hl, nl = hist
                ok = (nl >= least) & (len(rows) - nl >= least)
                gain = np.where(ok, gl**2 / (hl + l2) + (sg - gl) ** 2 / (sh - hl + l2) - sg**2 / (sh + l2), -1)
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] <= 1e-6 or b >= len(edges[j]):
                    continue
                feature[i], threshold[i], left[i] = int(j), float(edges[j][b]), len(feature)
                for _side in range(2):
                    following.append(len(feature))
                    feature.append(-1), threshold.append(0.0), left.append(len(feature) - 1), value.append(0.0)
                node[rows] = left[i] + (binned[rows, j] > b)
                value[i] = 0.0
            level = following
        raw += np.array(value)[node]
    return Forest(*map(np.array, (feature, threshold, left, value, roots)), base, depth)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn, sample: int, id_col: str, text_col: str) -> DataFrame:
    """(text, y) of at most ``sample`` labelled documents for which ``learn`` holds, the same on each run."""
    marks = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull()).groupBy(labels[id_col].alias("_id")).agg(F.max(label_col).alias("y"))
    chosen = marks.where(learn(F.col("_id"))).orderBy(spread(F.col("_id"), 2**31), "_id").limit(sample)
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text"))
    # at most ``sample`` identifiers and labels
    return texts.join(F.broadcast(chosen), "_id").select("_id", "text", F.col("y").cast("int").alias("y"))


def score_documents(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, held: int = 0, sample: int = SAMPLE,
    threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted``; labels of held-out documents are not learned."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "y": b["y"], "x": list(statistics_matrix(b["text"]))})

    chosen = labelled_sample(docs, labels, label_col, lambda i: crc_mod(i, folds) != held, sample, id_col, text_col)
    rows = chosen.mapInPandas(measured, "_id long, y int, x array<double>").toPandas().sort_values("_id")
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    forest = fit_forest(x, rows["y"].to_numpy(dtype=np.float64))
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = shared.value.score(statistics_matrix(b["text"]))
            yield pd.DataFrame({"id": b["id"], "held_out": b["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    held_out = F.coalesce(crc_mod(docs[id_col], folds) == held, F.lit(False))
    source = docs.select(docs[id_col].cast("long").alias("id"), held_out.alias("held_out"), docs[text_col].alias("text"))
    return source.mapInPandas(scored, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
