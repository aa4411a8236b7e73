"""Instance clustering per group: spectral, density, components, and summaries of clusters.

Eigenvectors need a group's whole matrix, so those steps run per group in Arrow-based functions; everything else is
relational. A group is a place or a set of chosen views, whose size does not grow with the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .similarity import both_ways


def normalised_laplacian(a: np.ndarray) -> np.ndarray:
    """I - D^-1/2 A D^-1/2 with the diagonal of A at 1; rows without degree have 1 on the diagonal."""
    degree = a.sum(axis=1)
    inverse = np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, 1e-300)), 0.0)
    out = np.eye(len(a)) - inverse[:, None] * a * inverse[None, :]
    out[degree <= 0, degree <= 0] = 1.0
    return (out + out.T) / 2


def plain_laplacian(a: np.ndarray) -> np.ndarray:
    """The other convention: A's diagonal left out, isolated rows all zero."""
    w = a - np.diag(np.diag(a))
    degree = w.sum(axis=1)
    inverse = np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, 1e-300)), 0.0)
    return np.diag((degree > 0).astype(float)) - inverse[:, None] * w * inverse[None, :]


def connectivity(a: np.ndarray) -> np.ndarray:
    """Component numbers on entries above 0, in order of first member."""
    label = np.full(len(a), -1)
    for i in range(len(a)):
        if label[i] >= 0:
            continue
        label[i], queue, number = label.max() + 1, [i], label.max() + 1
        number = label[i]
        while queue:
            reached = np.flatnonzero((a[queue.pop()] > 0) & (label < 0))
            label[reached] = number
            queue += reached.tolist()
    return label


def eigengap(a: np.ndarray, most: int | None = None) -> int:
    """Number of clusters at the first largest gap of eigenvalues, at least the number of components."""
    n = len(a)
    if n <= 1 or not ((a - np.diag(np.diag(a))) > 0).any():
        return n
    values = np.sort(np.linalg.eigvalsh(normalised_laplacian(a)))
    low, high = int(connectivity(a).max()) + 1, max(1, min(n, most or n))
    gaps = values[1:] - values[:-1]
    return max(range(low, high), key=lambda k: (round(float(gaps[k - 1]), 9), -k)) if low < high else low


def kmeans(x: np.ndarray, k: int, seed: int = 0, starts: int = 8, rounds: int = 100) -> np.ndarray:
    """Lloyd's algorithm from k-means++ seeds, the best of several starts; an empty cluster takes the farthest point."""
    best, labels = np.inf, np.zeros(len(x), dtype=int)
    for s in range(starts):
        rng = np.random.default_rng(seed + s)
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(-1).min(axis=1)
            pick = rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))
            centres = np.vstack([centres, x[pick]])
        mine = None
        for _ in range(rounds):
            d = ((x[:, None] - centres[None]) ** 2).sum(-1)
            new = d.argmin(axis=1)
            if mine is not None and (new == mine).all():
                break
            mine = new
            for c in range(k):
                centres[c] = x[mine == c].mean(axis=0) if (mine == c).any() else x[d.min(axis=1).argmax()]
        cost = d[np.arange(len(x)), mine].sum()
        if cost < best - 1e-12:
            best, labels = cost, mine
    return labels


def by_smallest(labels: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Clusters renumbered in the order of their smallest id; noise (-1) stays."""
    order = {c: i for i, c in enumerate(sorted({c for c in labels if c >= 0}, key=lambda c: ids[labels == c].min()))}
    return np.array([order.get(c, -1) for c in labels])


def spectral(a: np.ndarray, ids: np.ndarray, clusters: int | None = None, seed: int = 0) -> tuple[np.ndarray, str]:
    """Labels and the reason for them."""
    n = len(a)
    if n == 0:
        return np.zeros(0, dtype=int), "empty"
    if n == 1:
        return np.zeros(1, dtype=int), "singleton"
    if not ((a - np.diag(np.diag(a))) > 0).any():
        return by_smallest(np.arange(n), ids), "zero_affinity_graph"
    k = clusters or eigengap(a)
    if k <= 1:
        return np.zeros(n, dtype=int), "single_cluster"
    if k >= n:
        return by_smallest(np.arange(n), ids), "all_singletons"
    vectors = np.linalg.eigh(normalised_laplacian(a))[1][:, :k]
    rows = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return by_smallest(kmeans(rows, k, seed), ids), "spectral"


def dbscan(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Density clusters in order of their first core point; border points go to the first cluster that reaches them."""
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core, label, number = near.sum(axis=1) >= least, np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        queue = [i]
        label[i] = number
        while queue:
            p = queue.pop(0)
            if core[p]:
                reached = np.flatnonzero(near[p] & (label < 0))
                label[reached] = number
                queue += reached.tolist()
        number += 1
    return label


def dbscan_eps(x: np.ndarray, least: int) -> float:
    """The median distance to the ``least``-th nearest other point."""
    if len(x) < 2:
        return 0.0
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), axis=1)
    return float(np.median(d[:, min(least, len(x) - 1)]))


def _matrix(group: pd.DataFrame, ids: np.ndarray, value: str) -> np.ndarray:
    a, at = np.eye(len(ids)), {i: n for n, i in enumerate(ids)}
    known = group[group["j"].notna()]
    rows, cols = known["i"].map(at).to_numpy(dtype=int), known["j"].map(at).to_numpy(dtype=int)
    a[rows, cols] = a[cols, rows] = known[value].to_numpy()
    return a


def _per_group(objects: DataFrame, pairs: DataFrame, group: str, value: str) -> DataFrame:
    """Pairs with a row for each object too, so that objects without partners are there."""
    alone = objects.select(group, F.col("object_global_id").alias("i"), F.lit(None).cast("long").alias("j"), F.lit(None).cast("double").alias(value))
    return pairs.select(group, "i", "j", value).unionByName(alone)


def spectral_clusters(objects: DataFrame, pairs: DataFrame, group: str, value: str = "affinity", clusters: int | None = None) -> DataFrame:
    """(group, object_global_id, cluster, reason) from an affinity table."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf.loc[pdf["j"].isna(), "i"].unique()).astype(np.int64)
        labels, reason = spectral(_matrix(pdf, ids, value), ids, clusters)
        return pd.DataFrame({group: key[0], "object_global_id": ids, "cluster": labels.astype(np.int64), "reason": reason})

    return _per_group(objects, pairs, group, value).groupBy(group).applyInPandas(run, f"{group} string, object_global_id long, cluster long, reason string")


def density_clusters(objects: DataFrame, graph: DataFrame, group: str, value: str = "weight", dims: int = 6, least: int = 2, eps: float | None = None) -> DataFrame:
    """(group, object_global_id, cluster): density clusters of the spectral embedding of a neighbour graph; -1 is noise."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf.loc[pdf["j"].isna(), "i"].unique()).astype(np.int64)
        a = _matrix(pdf, ids, value)
        x = np.linalg.eigh(normalised_laplacian(a))[1][:, : min(dims, len(ids))]
        labels = dbscan(x, eps if eps is not None else dbscan_eps(x, least), least)
        return pd.DataFrame({group: key[0], "object_global_id": ids, "cluster": by_smallest(labels, ids).astype(np.int64)})

    return _per_group(objects, graph, group, value).groupBy(group).applyInPandas(run, f"{group} string, object_global_id long, cluster long")


def relabelled(labels: DataFrame, group: str) -> DataFrame:
    """Clusters numbered from 0 by their smallest object."""
    least = labels.withColumn("_m", F.min("object_global_id").over(Window.partitionBy(group, "cluster")))
    return least.withColumn("cluster", F.dense_rank().over(Window.partitionBy(group).orderBy("_m")) - 1).drop("_m")


def medoids(labels: DataFrame, sims: DataFrame, group: str) -> DataFrame:
    """The member with the highest mean similarity within its cluster, itself included; the smallest id on ties."""
    l = labels.select(group, "cluster", "object_global_id")  # noqa: E741
    one, two = (l.select(group, F.col("cluster").alias(f"c{s}"), F.col("object_global_id").alias(s)) for s in "ab")
    inner = both_ways(sims, group, "sim").join(one, [group, "a"]).join(two, [group, "b"]).where("ca = cb")
    total = inner.groupBy(group, F.col("ca").alias("cluster"), F.col("a").alias("object_global_id")).agg(F.sum("w").alias("s"))
    sizes = l.groupBy(group, "cluster").agg(F.count(F.lit(1)).alias("n"))
    mean = l.join(total, [group, "cluster", "object_global_id"], "left").join(sizes, [group, "cluster"]).withColumn("mean_sim", (1 + F.coalesce("s", F.lit(0.0))) / F.col("n"))
    return mean.groupBy(group, "cluster").agg(F.min_by(F.struct(F.col("object_global_id").alias("medoid"), "mean_sim"), F.struct(-F.bround("mean_sim", 9), "object_global_id")).alias("_r")).select(group, "cluster", "_r.*")


def summaries(labels: DataFrame, objects: DataFrame, group: str) -> DataFrame:
    """Size, members, labels, and whether two members come from one view, for each cluster."""
    rows = labels.select(group, "cluster", "object_global_id").join(objects.select("object_global_id", "label", "view_id"), "object_global_id")
    counts = rows.groupBy(group, "cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    histogram = counts.groupBy(group, "cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_histogram"))
    whole = rows.groupBy(group, "cluster").agg(
        F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("object_global_id")).alias("members"),
        (F.count(F.lit(1)) > F.countDistinct("view_id")).alias("same_view_collision"), F.countDistinct("view_id").alias("n_views"),
    )
    return whole.join(histogram, [group, "cluster"])


def block_order(labels: DataFrame, group: str) -> DataFrame:
    """Order of objects by cluster for display: noise last, larger first, then smallest id; and where a block ends."""
    by = Window.partitionBy(group, "cluster")
    rows = labels.withColumns({"_n": F.count(F.lit(1)).over(by), "_m": F.min("object_global_id").over(by)})
    order = Window.partitionBy(group).orderBy(F.col("cluster") < 0, F.desc("_n"), "_m", "cluster", "object_global_id")
    placed = rows.withColumn("position", F.row_number().over(order) - 1).withColumn("block_end", F.coalesce(F.lead("cluster").over(order) != F.col("cluster"), F.lit(False)))
    return placed.drop("_n", "_m")


def co_clusters(labels: DataFrame, group: str) -> DataFrame:
    """Pairs of objects that share a cluster."""
    a = labels.where("cluster >= 0").select(group, "cluster", F.col("object_global_id").alias("i"))
    return a.join(a.select(group, "cluster", F.col("i").alias("j")), [group, "cluster"]).where("i < j")
