"""Exact dedup by a content sort (DataFrame functions only).

Sampled splitters range-partition the normalised bytes, an external sort within each partition puts equal texts side by
side, and a full comparison of neighbours finds where a new text begins. The row with the smallest identifier stays.

* Splitters are sampled from the first ``PREFIX`` characters and the text's SHA-256, which are functions of the text:
  equal texts always meet, and the driver's sample holds no whole texts.
* A text held by many rows would fill one partition. A counting pass over the SHA-256, combined before its shuffle, finds
  the texts whose rows hold more than ``TASK_BYTES`` together, and never more than ``MOST_HOT`` of them, which bounds
  what is broadcast: where the input is larger than that many such texts, the bytes allowed grow with it. Their rows are
  sorted in as many parts as their bytes fill, by a digest of the identifier, or of the row where that is missing.

Defined results: a null text counts as empty; texts are equal when identical after each run of white space became one
space; of rows that also share the smallest identifier exactly one stays; null identifiers come after all others, and
if all are null, one of them stays; an empty table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import clean_text, materialise, utf8

PREFIX = 48
#: Bytes of one text's rows that one part of the sort may hold; a row is taken to have this many beside its text.
TASK_BYTES, ROW_BYTES = 32_000_000, 64
#: Texts that may be sorted in parts: the bound of what is broadcast.
MOST_HOT = 65_536


def with_normalised(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``_norm``: each run of `[\\x20\\x09-\\x0D]` becomes one space; few texts need the regular expression."""
    flat = clean_text(text)
    for c in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    spaced = df.withColumn("_flat", flat)
    once = F.when(F.contains("_flat", F.lit("  ")), F.regexp_replace("_flat", " {2,}", " ")).otherwise(F.col("_flat"))
    return spaced.withColumn("_norm", once).drop("_flat")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per document: ``row`` (the input's columns), ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    wrapped = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    keyed = with_normalised(wrapped, F.col("_text")).withColumn("_sha", F.sha2(utf8(F.col("_norm")), 256))
    counts = materialise(
        keyed.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least"), F.sum(F.octet_length("_norm") + ROW_BYTES).alias("_bytes")).where("_n > 1"),
        "exact-counts",
    )
    # groups of one row are at most as many bytes as the input has, so the total of the others bounds their number
    allowed = F.greatest(F.lit(float(task_bytes)), F.sum("_bytes") / MOST_HOT)
    limit = counts.agg(allowed.alias("limit")).first()["limit"] or float(task_bytes)
    hot = counts.where(F.col("_bytes") > limit).withColumn("_parts", F.ceil(F.col("_bytes") / F.lit(limit)).cast("long"))
    known = hot.select("_sha", "_n", "_least", "_parts").collect()  # at most MOST_HOT rows
    salt = F.lit(0)
    if known:
        known = docs.sparkSession.createDataFrame([tuple(r) for r in known], hot.select("_sha", "_n", "_least", "_parts").schema)
        keyed = keyed.join(F.broadcast(known), "_sha", "left")
        own = F.when(F.col("_id").isNotNull(), F.xxhash64("_id")).otherwise(F.xxhash64(F.monotonically_increasing_id()))
        salt = F.when(F.col("_parts").isNotNull(), F.pmod(own, F.col("_parts"))).otherwise(F.lit(0))
    else:
        known, keyed = None, keyed.withColumns({c: F.lit(None) for c in ("_n", "_least", "_parts")})

    sorted_rows = keyed.select(
        "row", "_id", "_norm", "_sha", "_n", "_least", "_parts", F.substring("_norm", 1, PREFIX).alias("_prefix"), salt.cast("int").alias("_salt")
    ).repartitionByRange("_prefix", "_sha", "_salt")
    run = Window.partitionBy("_prefix", "_sha", "_salt", "_norm")
    first = run.orderBy(F.col("_id").asc_nulls_last())
    alone = F.col("_parts").isNull()
    found = sorted_rows.select(
        "row", "_salt",
        F.when(alone, F.first("_id").over(first)).otherwise(F.col("_least")).alias("keep_id"),
        F.when(alone, F.count(F.lit(1)).over(run)).otherwise(F.col("_n")).alias("group_size"),
        ((F.row_number().over(first) == 1) & (alone | F.col("_id").eqNullSafe(F.col("_least")))).alias("kept"),
        (~alone & F.col("_least").isNull()).alias("_nameless"),
        F.col("_sha").alias("text_sha256"),
    )
    if known is not None and not known.where("_least is null").isEmpty():
        # each part of a text without any identifier keeps a row: that of the first part stays
        found = materialise(found, "exact-found")
        stays = found.where("_nameless and kept").groupBy(F.col("text_sha256").alias("_sha")).agg(F.min("_salt").alias("_first"))
        found = found.join(stays, found["text_sha256"] == stays["_sha"], "left").withColumn("kept", F.col("kept") & (~F.col("_nameless") | (F.col("_salt") == F.col("_first"))))
    return found.select("row", "keep_id", "group_size", "kept", "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with the columns of the input."""
    return exact_dedup(docs, id_col, text_col).where("kept").select("row.*")
