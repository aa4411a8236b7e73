"""The same resolution as a stream: views arrive in order of ``step`` within a scene, clusters are kept as state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.incremental import advance

CHANGES = "scene string, step int, case string, cluster_id long, object_global_id long"


def resolve_stream(observations: DataFrame) -> DataFrame:
    """What each view changed. A view that comes after a later one of its scene is left out, and reported as ``late``.

    A view's objects must arrive in one batch; state is dropped with the query's checkpoint.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clusters, following, last = pickle.loads(state.get[0]) if state.exists else ([], 0, -1)
        pdf = pd.concat(list(batches), ignore_index=True)
        pdf = pdf.astype(object).where(pdf.notna(), None)
        out = []
        for number, rows in pdf.groupby("step", sort=True):
            if number <= last:
                out += [(key[0], int(number), "late", -1, int(i)) for i in rows["object_global_id"]]
                continue
            clusters, following, events = advance(clusters, rows.to_dict("records"), following)
            last = int(number)
            out += [(key[0], last, case, int(c), int(o)) for case, c, o in events]
        state.update((pickle.dumps((clusters, following, last)),))
        yield pd.DataFrame(out, columns=["scene", "step", "case", "cluster_id", "object_global_id"])

    return observations.groupBy("scene").applyInPandasWithState(step, CHANGES, "state binary", "append", GroupStateTimeout.NoTimeout)
