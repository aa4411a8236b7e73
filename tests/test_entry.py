"""The driver's contract, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

REPO = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = ["rank_position_dedup", "polar_relations", "direction_edges", "mine_pairs", "pair_best_threshold", "semantic_rooms", "label_canonicalize", "graph_direction_objects"]


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


def test_every_oracle_belongs_to_a_query():
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", CHEAP)
def test_same_rows_as_sql(spark, name):
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = base.execute(contract.oracle_sql()[name])
    columns = sorted(c[0] for c in found.description)
    want = [{c[0]: plain(v) for c, v in zip(found.description, row)} for row in found.fetchall()]
    df = contract.queries()[name](spark, DATA)
    assert sorted(df.columns) == columns
    got = [{c: plain(r[c]) for c in columns} for r in df.collect()]
    key = lambda r: repr([r[c] for c in columns])
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_imports_without_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(REPO / "quarrylight", tmp_path / "quarrylight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print('rank_position_dedup' in q, any(k.startswith('op') for k in q))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.split() == ["True", "False"], said.stderr
