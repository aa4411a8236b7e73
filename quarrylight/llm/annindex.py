"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beams.

Vectors are dealt into shards of about ``SHARD_ROWS`` by a digest of their identifier, as many as the table needs, so
that a shard's index always fits in one task. Within a shard vectors of equal direction, in single precision, are one
node; its members are scored one by one, so what is too near to tell apart for a beam is told apart afterwards. A node
gets its edges from a greedy search for it in the graph so far: the nodes visited are its candidates, and a candidate is
kept unless a nearer one that was kept is ``ALPHA`` times nearer to it (relaxed pruning keeps edges that are diverse);
reverse edges are added and pruned alike. Besides, each node keeps ``FAR`` edges to nodes drawn at random, by which a beam
leaves a large group of near copies, whose edges else all stay within it. Nodes are inserted in blocks that double in size and then once more, so numpy
runs all searches of a block at once. The graphs are written as a table, one row per node.

Queries meet each shard in blocks of ``query_block``, which bounds the memory of a task; beams start from the node nearest
to the mean of the shard. All nodes that a beam ends with are scored in double precision on the original vectors of
their members, and the best of all shards are ranked.

Defined results: vectors that are null, empty, zero, of another dimension than most, or hold nulls or non-finite numbers
take no part, as query or candidate, nor do null identifiers; a query's own row is no candidate, other rows with an
equal vector are; ties go to the smaller identifier; with fewer candidates than asked for, all are returned; rows that
repeat an identifier count as one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

SHARD_ROWS = 16_384
QUERY_BLOCK = 32_768
DEGREE, FAR, BUILD_BEAM, ALPHA = 32, 8, 48, 1.2
SEARCH_BEAM = 128
FIRST_BLOCK, LARGEST_BLOCK = 64, 1024
NO_NODE = -1


def _distances(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors, infinite for missing nodes; q (m, d), ids (m, r)."""
    dots = np.einsum("md,mrd->mr", q, x[np.maximum(ids, 0)], optimize=False)
    return np.where(ids == NO_NODE, np.inf, 2 - 2 * dots)


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest nodes found (ids, distances), nearest first, NO_NODE where fewer.

    All queries step together: each expands its nearest node that it has not expanded, until none is left.
    """
    m = len(q)
    ids = np.full((m, beam), NO_NODE, dtype=np.int64)
    dist = np.full((m, beam), np.inf)
    done = np.zeros((m, beam), dtype=bool)
    ids[:, 0] = start
    dist[:, 0] = _distances(x, q, ids[:, :1])[:, 0]
    seen = np.zeros((m, len(x)), dtype=bool)
    seen[:, start] = True
    active = np.arange(m)
    while len(active):
        todo = np.where(done[active] | (ids[active] == NO_NODE), np.inf, dist[active])
        at = todo.argmin(axis=1)
        live = np.isfinite(todo[np.arange(len(active)), at])
        active, at = active[live], at[live]
        if not len(active):
            break
        done[active, at] = True
        near = graph[ids[active, at]]
        new = (near != NO_NODE) & ~seen[active[:, None], np.maximum(near, 0)]
        near = np.sort(np.where(new, near, NO_NODE), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = NO_NODE
        rows, cols = np.nonzero(near != NO_NODE)
        seen[active[rows], near[rows, cols]] = True
        d = _distances(x, q[active], near)
        all_ids, all_dist = np.concatenate([ids[active], near], axis=1), np.concatenate([dist[active], d], axis=1)
        all_done = np.concatenate([done[active], np.zeros(near.shape, dtype=bool)], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[active], dist[active], done[active] = (np.take_along_axis(a, best, axis=1) for a in (all_ids, all_dist, all_done))
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Out-edges (len(nodes), degree) of ``nodes`` from candidates (len(nodes), c), all at once."""
    cand = np.where(cand == nodes[:, None], NO_NODE, cand)
    cand = np.sort(cand, axis=1)[:, ::-1]
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = NO_NODE
    dist = _distances(x, x[nodes], cand)
    order = np.argsort(dist, axis=1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, axis=1), np.take_along_axis(dist, order, axis=1)
    width = int((cand != NO_NODE).sum(axis=1).max(initial=0))
    cand, dist = cand[:, :width], dist[:, :width]
    vectors = x[np.maximum(cand, 0)]
    between = 2 - 2 * np.einsum("mad,mbd->mab", vectors, vectors, optimize=True)
    alive = cand != NO_NODE
    out = np.full((len(nodes), degree), NO_NODE, dtype=np.int64)
    count = np.zeros(len(nodes), dtype=np.int64)
    for j in range(width):
        take = np.flatnonzero(alive[:, j] & (count < degree))
        out[take, count[take]] = cand[take, j]
        count[take] += 1
        alive[take] &= alpha * alpha * between[take, j] > dist[take]
        alive[take, j] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, far: int = FAR) -> tuple[np.ndarray, int]:
    """Edges (n, degree + far) and the start node of unit vectors (n, d)."""
    n = len(x)
    start = int((x @ x.mean(axis=0)).argmax())
    every = np.full((n, degree + far), NO_NODE, dtype=np.int64)
    every[:, degree:] = np.random.default_rng(n + 1).integers(0, n, (n, far))
    graph = every[:, :degree]
    order = np.concatenate([[start], np.random.default_rng(n).permutation(np.delete(np.arange(n), start))])
    sizes, at = [], 1
    while at < n:
        sizes.append((at, min(n, at + min(LARGEST_BLOCK, max(FIRST_BLOCK, at)))))
        at = sizes[-1][1]
    again = [(a, min(n, a + LARGEST_BLOCK)) for a in range(0, n, LARGEST_BLOCK)] if n > FIRST_BLOCK else []
    for a, b in sizes + again:
        block = order[a:b]
        found, _ = beam_search(x, every, start, x[block], beam)
        # those of one block do not find each other in the first pass
        mates = np.broadcast_to(block, (len(block), len(block))) if len(block) <= FIRST_BLOCK else np.empty((len(block), 0), dtype=np.int64)
        graph[block] = robust_prune(x, block, np.concatenate([found, graph[block], mates], axis=1), degree, alpha)
        source, target = np.repeat(block, degree), graph[block].ravel()
        source, target = source[target != NO_NODE], target[target != NO_NODE]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, many = np.unique(target, return_index=True, return_counts=True)
        # back edges in groups of nodes with like numbers of them, so that the arrays stay small
        for low, high in ((1, 16), (17, 128), (129, n)):
            some = np.flatnonzero((many >= low) & (many <= high))
            for part in np.array_split(some, max(1, len(some) * min(high, int(many.max(initial=1))) // 50_000)):
                if len(part):
                    wide = int(many[part].max())
                    slots = first[part][:, None] + np.arange(wide)
                    back = np.where(np.arange(wide) < many[part][:, None], source[np.minimum(slots, len(source) - 1)], NO_NODE)
                    joint = np.concatenate([graph[nodes[part]], back], axis=1)
                    if wide > 128:
                        joint = _nearest(x, nodes[part], joint, 128 + degree)
                    graph[nodes[part]] = robust_prune(x, nodes[part], joint, degree, alpha)
    return every, start


def _nearest(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, keep: int) -> np.ndarray:
    dist = np.concatenate([_distances(x, x[nodes[i : i + 1]], cand[i : i + 1]) for i in range(len(nodes))])
    return np.take_along_axis(cand, np.argsort(dist, axis=1, kind="stable")[:, :keep], axis=1)


def _index(group: pd.DataFrame) -> pd.DataFrame:
    """A row for each distinct vector of a shard: its node, the identifiers that have it, the vector; on the first of each node its edges."""
    group = group.sort_values("id", ignore_index=True)
    vectors = np.stack(group["v"].to_numpy()).astype(np.float64)
    distinct, which = np.unique(vectors, axis=0, return_inverse=True)
    by = np.argsort(which.ravel(), kind="stable")
    members = np.split(group["id"].to_numpy()[by], np.cumsum(np.bincount(which.ravel()))[:-1])
    unit = (distinct / np.linalg.norm(distinct, axis=1, keepdims=True)).astype(np.float32)
    nodes, first, node = np.unique(unit, axis=0, return_index=True, return_inverse=True)
    graph, start = build_graph(nodes)
    edges = [None] * len(distinct)
    for i, at in enumerate(first):
        edges[at] = graph[i]
    return pd.DataFrame({"shard": group["shard"].iloc[0], "node": node.ravel(), "members": members, "v": list(distinct), "edges": edges, "start": (node.ravel() == start) & np.isin(np.arange(len(distinct)), first)})


def cosine(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row in double precision, so that equal vectors get equal scores wherever they are."""
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, one for each identifier."""
    v = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & ~F.coalesce(F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(True))
        & F.exists("v", lambda e: e != 0)
    )
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of (id, v) as a stored table."""
    shards = max(1, -(-rows.count() // shard_rows))
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    built = sharded.groupBy("shard").applyInPandas(_index, "shard long, node int, members array<long>, v array<double>, edges array<int>, start boolean")
    return materialise(built, "ann-index")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = SEARCH_BEAM,
    shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries``: query_id, rank, id, score."""
    rows = materialise(usable(vectors, id_col, vector_col), "ann-rows")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = dims["d"] if dims else 0
    index = build_index(rows.where(F.size("v") == dim), shard_rows)
    asked = usable(queries, id_col, vector_col).where(F.size("v") == dim)
    blocks = max(1, -(-asked.count() // query_block))
    # every shard, in every block of queries
    keys = index.where("start").select(F.col("shard").alias("to_shard"))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    placed = asked.select("id", "v", block.cast("long").alias("to_block")).join(keys.withColumn("to_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))), "to_block")
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(rows: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        if len(rows) and len(batch):
            rows = rows.sort_values("node", kind="stable", ignore_index=True)
            v, node = np.stack(rows["v"].to_numpy()), rows["node"].to_numpy()
            heads = rows[rows["edges"].notna()]
            unit = np.stack(heads["v"].to_numpy())
            unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
            graph = np.stack(heads["edges"].to_numpy()).astype(np.int64)
            start = int(heads["node"].to_numpy()[heads["start"].to_numpy()][0])
            begin = np.searchsorted(node, np.arange(len(heads) + 1))
            # more than k + 1 identifiers of one vector are never among the nearest
            members = [m[: k + 1] for m in rows["members"]]
            q, ids = np.stack(batch["v"].to_numpy()), batch["id"].to_numpy()
            unit_q = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32)
            for a in range(0, len(q), 256):
                found, _ = beam_search(unit, graph, start, unit_q[a : a + 256], beam)
                for i, near in enumerate(found, start=a):
                    near = near[near != NO_NODE]
                    at = np.concatenate([np.arange(begin[x], begin[x + 1]) for x in near])
                    score = cosine(v[at], q[i])
                    many = np.array([len(members[x]) for x in at])
                    mine, score = np.concatenate([members[x] for x in at]), np.repeat(score, many)
                    score, mine = score[mine != ids[i]], mine[mine != ids[i]]
                    best = np.lexsort((mine, -score))[:k]
                    out.append((np.full(len(best), ids[i]), mine[best], score[best]))
        query, near, score = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"query_id": query.astype(np.int64), "id": near.astype(np.int64), "score": score})

    found = spread.groupBy("shard", "block").cogroup(placed.groupBy("to_shard", "to_block")).applyInPandas(search, "query_id long, id long, score double")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
