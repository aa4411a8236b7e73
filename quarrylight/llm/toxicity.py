"""Toxicity: a counterfactual-regularised logistic classifier on the words of whole texts.

A text is the set of its words (lower case, outer punctuation off) and of the beginnings of words, of ``STEMS`` letters,
that at least ``STEM_SHARE`` of its words have, since one stem has many forms; all are hashed. Identity
terms have no stems, so that a swap changes whole words only. From at most ``SAMPLE`` labelled documents, chosen by a
digest of their identifier (the bound is a parameter), the executors make sets of hashes and, for each
sentence with identity terms, the swaps of each term for others of its group and language. The driver receives counts
for each hash, selects the words that tell the classes apart most, receives which of those each document has, and fits their weights by Newton steps on the logistic loss, a ridge and the penalty
``PENALTY * (score(sentence) - score(swapped sentence))**2``, averaged over the swaps. Scores here are
the model's sums of weights; since identity terms have no stems, a swap changes them by the difference of two words'
weights, or by the term's weight alone where the sentence has the substitute already. A group's mere mention so cannot carry weight that mentions of others don't carry, and
since neutral mentions occur in both classes, it carries hardly any. Every whole text is scored on the executors.

Defined results: a null or empty text has no words and gets the score of the intercept; labels that are null or belong
to no document are not used, and of a document with several labels the largest counts; equal word sets are learned from
once; with labels of one kind, or none, the score is 1 or 0; a null identifier is not held
out and not learned from; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialise
from .quality import labelled_sample

SAMPLE = 20_000
HASHES = 2**20
WORDS, LEAST_DOCS, LEAST_Z = 512, 4, 4.0
RIDGE, PENALTY = 0.003, 5.0
STEMS, STEM_SHARE = (4, 5, 6, 7), 0.006
THRESHOLD = 0.3
KEPT_WORDS = 500_000
EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»„“”‘’…–—¿¡"
SENTENCE_ENDS = ".!?\n"

# Identity terms, a line for each group and language; a term is swapped for the others of its line.
IDENTITY_TERMS = """
muslim christian jewish hindu buddhist atheist catholic protestant
muslims christians jews hindus buddhists atheists catholics protestants
gay lesbian straight bisexual transgender queer
black white asian latino african european
women men
woman man
immigrants refugees natives foreigners
muslime christen juden hindus buddhisten atheisten
frauen männer
schwarze weiße asiaten
musulman chrétien juif hindou bouddhiste athée
femmes hommes
noirs blancs asiatiques
musulmán cristiano judío hindú budista ateo
mujeres hombres
negros blancos asiáticos
"""
SWAPS: dict[str, list[str]] = {}
for _line in IDENTITY_TERMS.strip().splitlines():
    for _term in _line.split():
        SWAPS.setdefault(_term, []).extend(t for t in _line.split() if t != _term)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) % HASHES


class Words(dict):
    """Raw word -> numbers of its stripped form and its stems, those that ``wanted`` holds if given.

    A worker forgets all words beyond a bound.
    """

    def __init__(self, wanted=None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, raw: str) -> tuple[int, tuple[int, ...]]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        word = raw.strip(EDGES)
        own = word_hash(word) if word else -1
        stems = () if word in SWAPS else tuple(word_hash("^" + word[:k]) for k in STEMS if len(word) > k)
        if self.wanted is not None:
            own, stems = own if own in self.wanted else -1, tuple(h for h in stems if h in self.wanted)
        out = self[raw] = own, stems
        return out


def word_set(text: str | None, words: Words) -> set[int]:
    """Numbers of the words and frequent stems of a whole text."""
    raw = text.lower().split() if text else []
    found, stems = set(), {}
    for own, begins in map(words.__getitem__, raw):
        if own >= 0:
            found.add(own)
        for h in begins:
            stems[h] = stems.get(h, 0) + 1
    least = STEM_SHARE * len(raw)
    found.update(h for h, n in stems.items() if n >= least)
    return found


def swaps_in(text: str | None) -> list[int]:
    """What each swap changes: term * HASHES + substitute, for each identity term of each sentence and each other of its group.

    A substitute that the sentence has already brings no feature: the pair is then the term with itself.
    """
    if not text:
        return []
    low, out = text.lower(), []
    if not any(t in low for t in SWAPS):
        return []
    for end in SENTENCE_ENDS[1:]:
        low = low.replace(end, SENTENCE_ENDS[0])
    for sentence in low.split(SENTENCE_ENDS[0]):
        words = {w.strip(EDGES) for w in sentence.split()}
        for term in sorted(words & SWAPS.keys()):
            out += [word_hash(term) * HASHES + word_hash(term if other in words else other) for other in SWAPS[term]]
    return out


@dataclass
class Model:
    """Weights of the selected word hashes, sorted, and the intercept."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def weight_of(self) -> dict[int, float]:
        return dict(zip(self.hashes.tolist(), self.weights.tolist()))


def select_words(hashes: np.ndarray, with_word: np.ndarray, toxic_with: np.ndarray, n: int, pos: int, swaps: dict[int, int], words: int = WORDS) -> np.ndarray:
    """The hashes that tell the classes apart most by a two-sample z, and those that swaps name; sorted."""
    share = with_word / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / pos + 1 / (n - pos)))
    z = np.abs(toxic_with / pos - (with_word - toxic_with) / (n - pos)) / spread
    z[with_word < LEAST_DOCS] = 0
    best = np.lexsort((hashes, -z))[:words]
    named = [h for s in swaps for h in (s // HASHES, s % HASHES)]
    return np.unique(np.concatenate([hashes[best[z[best] >= LEAST_Z]], np.array(named, dtype=np.int64)]).astype(np.int64))


def fit(sets: list[np.ndarray], y: np.ndarray, hashes: np.ndarray, pairs: dict[int, int], ridge=RIDGE, penalty=PENALTY) -> Model:
    """Newton's method on documents given by the selected hashes that they have."""
    y = y.astype(np.float64)
    pos, neg = y.sum(), len(y) - y.sum()
    has = np.zeros((len(y), len(hashes) + 1), dtype=bool)
    has[:, -1] = True
    for i, s in enumerate(sets):
        has[i, np.searchsorted(hashes, s)] = True
    fixed = ridge * np.eye(len(hashes) + 1)
    fixed[-1, -1] = 1e-6
    total = sum(pairs.values())
    for s, n in pairs.items():
        a, b = np.searchsorted(hashes, (s // HASHES, s % HASHES))
        d = np.zeros(len(hashes) + 1)
        d[a] = 1
        if b != a:
            d[b] = -1
        fixed += 2 * penalty * (n / total) * len(pairs) * np.outer(d, d)
    w = np.zeros(len(hashes) + 1)
    w[-1] = np.log(pos / neg)
    blocks = [slice(i, i + 2000) for i in range(0, len(y), 2000)]

    def raw_scores(w: np.ndarray) -> np.ndarray:
        return np.concatenate([has[b] @ w for b in blocks])

    def loss(w: np.ndarray) -> float:
        raw = raw_scores(w)
        return float(np.logaddexp(0, raw).sum() - y @ raw + 0.5 * w @ fixed @ w)

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(raw_scores(w), -30, 30)))
        slope, bend = fixed @ w, fixed.copy()
        for b in blocks:
            x = has[b].astype(np.float64)
            slope += x.T @ (p[b] - y[b])
            bend += (x * (p[b] * (1 - p[b]))[:, None]).T @ x
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        w, gained, now = w - size * step, now - then, then
        if gained < 1e-6:
            break
    return Model(hashes, w[:-1], float(w[-1]))


def learn(rows: DataFrame) -> Model:
    """The model of (y, words, swaps), one row for each labelled document; equal sets of words count once."""
    once = rows.groupBy("words").agg(F.max("y").alias("y"))
    whole = once.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    if whole["pos"] in (0, whole["n"]):
        return Model(np.array([], dtype=np.int64), np.array([]), 50.0 if whole["n"] and whole["pos"] else -50.0)
    swaps = {r["s"]: r["count"] for r in rows.select(F.explode("swaps").alias("s")).groupBy("s").count().collect()}
    counts = once.select("y", F.explode("words").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).toArrow()
    hashes = select_words(*(counts[c].to_numpy().astype(np.int64) for c in ("h", "n", "pos")), whole["n"], whole["pos"], swaps)
    wanted = F.array(*(F.lit(int(h)) for h in hashes)).cast("array<int>")
    seen = once.select("y", F.array_sort(F.array_intersect("words", wanted)).alias("words")).toArrow()
    sets = [np.array(s, dtype=np.int64) for s in seen["words"].to_pylist()]
    order = sorted(range(len(sets)), key=lambda i: (sets[i].tobytes(), seen["y"][i].as_py()))
    return fit([sets[i] for i in order], seen["y"].to_numpy()[order], hashes, swaps)


def score_documents(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 4, held: int = 2, sample: int = SAMPLE,
    threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted``; with ``carry``, those columns of the input first."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "y": b["y"], "words": [sorted(word_set(t, words)) for t in b["text"]], "swaps": [swaps_in(t) for t in b["text"]]})

    chosen = labelled_sample(docs, labels, label_col, lambda i: crc_mod(i, folds) != held, sample, id_col, text_col)
    model = learn(materialise(chosen.mapInPandas(read, "_id long, y int, words array<int>, swaps array<long>"), "toxic-sample"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weight_of(), model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        words = Words(weights)
        for texts in batches:
            raw = np.array([bias + sum(weights[h] for h in sorted(word_set(t, words))) for t in texts], dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(raw, -60, 60))))

    held_out: Column = F.coalesce(crc_mod(docs[id_col], folds) == held, F.lit(False))
    source = docs.select(
        F.struct(*(docs[c] for c in carry or [id_col])).alias("row"), held_out.alias("held_out"), score(docs[text_col]).alias("score")
    )
    return source.select("row.*" if carry is None else "row", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with the columns of the input."""
    return score_documents(docs, labels, carry=docs.columns).where("predicted = 0").select("row.*")
