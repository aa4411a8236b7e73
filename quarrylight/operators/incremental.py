"""Entity resolution over an ordered sequence of views, with clusters carried as state.

One scene is one key. The transition from one view to the next is a plain function on a list of clusters, used alike by
the batch form (one ordered group per scene) and by the streaming form in ``streaming``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .clustering import connectivity, spectral

# Weights of text, position and polar agreement; reach of position in metres; least affinity of an edge
# between a cluster and an object, and for joining a cluster that is in another component.
WEIGHTS = (0.70, 0.20, 0.10)
SIGMA_M, LEAST_EDGE, LEAST_REJOIN = 2.0, 0.35, 0.75
POLAR_SCALES = (2.0, 45.0, 1.0)
INPUT = "scene string, step int, object_global_id long, view_id string, label string, vec array<double>, gx double, gy double, gz double, distance_m double, bearing_deg double, height_m double"
OUTPUT = "scene string, cluster_id long, object_global_id long, view_id string, label string, n_members int"


@dataclass
class Cluster:
    """Members in the order they joined; the prototype is the mean direction and the medians of what is known."""

    number: int
    members: list[dict] = field(default_factory=list)

    def views(self) -> set[str]:
        return {m["view_id"] for m in self.members if m["view_id"]}

    def prototype(self) -> dict:
        known = lambda c: [m[c] for m in self.members if m[c] is not None and np.isfinite(m[c])]
        mean = np.mean([m["vec"] for m in self.members], axis=0)
        middle = {c: float(np.median(known(c))) if known(c) else None for c in ("gx", "gy", "gz", "distance_m", "bearing_deg", "height_m")}
        return middle | {"vec": mean / max(float(np.linalg.norm(mean)), 1e-12)}


def affinity(row: dict, proto: dict) -> float:
    """Weighted over what both have: cosine, Gaussian of position, Gaussian of polar differences."""
    a = np.asarray(row["vec"]) / max(float(np.linalg.norm(row["vec"])), 1e-12)
    parts = [(WEIGHTS[0], float(a @ proto["vec"]))]
    delta = {c: None if row[c] is None or proto[c] is None or not np.isfinite(row[c]) else row[c] - proto[c] for c in ("gx", "gy", "gz", "distance_m", "bearing_deg", "height_m")}
    if delta["gx"] is not None and delta["gz"] is not None:
        d2 = delta["gx"] ** 2 + delta["gz"] ** 2 + (delta["gy"] or 0.0) ** 2
        parts.append((WEIGHTS[1], float(np.exp(-d2 / SIGMA_M**2))))
    if delta["bearing_deg"] is not None:
        delta["bearing_deg"] = (delta["bearing_deg"] + 180) % 360 - 180
    polar = [(delta[c] / s) ** 2 for c, s in zip(("distance_m", "bearing_deg", "height_m"), POLAR_SCALES) if delta[c] is not None]
    if polar:
        parts.append((WEIGHTS[2], float(np.exp(-sum(polar)))))
    return sum(w * s for w, s in parts) / sum(w for w, _ in parts)


def advance(clusters: list[Cluster], rows: list[dict], following: int) -> tuple[list[Cluster], int, list[tuple]]:
    """The clusters after one more view, the next free number, and what happened as (case, cluster, object)."""
    rows = sorted(rows, key=lambda r: r["object_global_id"])
    events: list[tuple] = []
    if not clusters:
        made = [Cluster(following + i, [r]) for i, r in enumerate(rows)]
        return made, following + len(made), [("seed", c.number, c.members[0]["object_global_id"]) for c in made]
    m, n = len(clusters), len(rows)
    protos = [c.prototype() for c in clusters]
    cross = np.array([[affinity(r, p) for r in rows] for p in protos]).reshape(m, n)
    graph = np.eye(m + n)
    graph[:m, m:] = np.where(cross >= LEAST_EDGE, cross, 0.0)
    graph[m:, :m] = graph[:m, m:].T
    labels, parts = spectral(graph, np.arange(m + n))[0], connectivity(graph)
    groups: dict[tuple, list[int]] = {}
    for node, key in enumerate(zip(labels.tolist(), parts.tolist())):
        groups.setdefault(key, []).append(node)
    ordered = sorted(groups.values(), key=lambda g: (min((i for i in g if i < m), default=m + n), min((i for i in g if i >= m), default=m + n)))
    live: dict[int, Cluster] = {i: Cluster(c.number, list(c.members)) for i, c in enumerate(clusters)}
    tails: list[Cluster] = []

    def start(members: list[dict], case: str) -> None:
        nonlocal following
        tails.append(Cluster(following, list(members)))
        events.extend((case, following, r["object_global_id"]) for r in members)
        following += 1

    def join(slot: int, row: dict, case: str) -> None:
        live[slot].members.append(row)
        events.append((case, live[slot].number, row["object_global_id"]))

    for group in ordered:
        old, new = [i for i in group if i < m and i in live], [i - m for i in group if i >= m]
        if old:
            shared = any(live[a].views() & live[b].views() for x, a in enumerate(old) for b in old[x + 1 :])
            if shared:
                # clusters that a view has kept apart stay apart; objects go to them one to one, best first
                edges = sorted((-cross[i, j], live[i].number, j, i) for i in old for j in new if cross[i, j] > 0)
                used, placed = set(), set()
                for _, _, j, i in edges:
                    if i not in used and j not in placed:
                        used.add(i), placed.add(j)
                        join(i, rows[j], "append_blocked_merge")
                for j in new:
                    if j not in placed:
                        start([rows[j]], "tail")
                continue
            target = min(old, key=lambda i: live[i].number)
            for i in sorted(old, key=lambda i: live[i].number):
                if i != target:
                    live[target].members += live[i].members
                    events.append(("merge", live[target].number, live[i].number))
                    del live[i]
            if new:
                proto = live[target].prototype()
                ranked = sorted(new, key=lambda j: (-affinity(rows[j], proto), j))
                join(target, rows[ranked[0]], "append")
                for j in sorted(ranked[1:]):
                    start([rows[j]], "tail")
        elif new:
            found = []
            for j in new:
                best = max(live, key=lambda i: (affinity(rows[j], live[i].prototype()), -i), default=None)
                found.append((affinity(rows[j], live[best].prototype()) if best is not None else -1.0, best, j))
            for score, slot, j in sorted(found, key=lambda f: (-f[0], f[1] if f[1] is not None else m, f[2])):
                if score >= LEAST_REJOIN:
                    join(slot, rows[j], "rejoin")
            rest = [rows[j] for score, _, j in sorted(found, key=lambda f: f[2]) if score < LEAST_REJOIN]
            if rest:
                start(rest, "new")
    return sorted([*live.values(), *tails], key=lambda c: c.number), following, events


def resolve(observations: DataFrame) -> DataFrame:
    """(scene, cluster_id, object_global_id, ...) after all views of each scene, in the order of ``step``."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        clusters: list[Cluster] = []
        following = 0
        pdf = pdf.astype(object).where(pdf.notna(), None)
        for _, rows in pdf.groupby("step", sort=True):
            clusters, following, _ = advance(clusters, rows.to_dict("records"), following)
        return members_table(key[0], clusters)

    return observations.groupBy("scene").applyInPandas(run, OUTPUT)


def members_table(scene: str, clusters: list[Cluster]) -> pd.DataFrame:
    rows = [(scene, c.number, m["object_global_id"], m["view_id"], m["label"], len(c.members)) for c in clusters for m in c.members]
    return pd.DataFrame(rows, columns=["scene", "cluster_id", "object_global_id", "view_id", "label", "n_members"])
