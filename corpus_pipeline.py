"""A training corpus from raw documents: five of the corpus operators in a row.

Each stage takes all documents its predecessor kept and returns those that it keeps, with the columns of ``documents``;
the last returns the pieces of packed sequences.

Defined results: a null text is an empty one in every stage; a row without identifier is judged like others, is no near
copy of any, and such rows are taken equally often by the mix, as are rows that share an identifier; of exact copies the
smallest identifier stays, of rows that repeat one of them; rows of a source without words are not in the mix; other
columns, whatever their names, stay until packing; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import materialise, table
from quarrylight.llm.exact import keep_first
from quarrylight.llm.minhash import keep_one_of_each
from quarrylight.llm.mixing import mix_sources
from quarrylight.llm.packing import pack
from quarrylight.llm.toxicity import keep_clean


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    times = mix_sources(docs).where("copies > 0").groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("id"))
    taken = rows.join(times, rows["id"].eqNullSafe(times["doc_id"]))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: The first stage is a trained classifier, so SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
