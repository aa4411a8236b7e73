"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

A source's expected number of copies of each of its documents is its target over its size. Prefix sums of the expected
copies over the documents of a source, shifted by one random offset of that source, cross an integer boundary as often
as a document is taken. Documents are ordered by size class first, so that the sample is spread evenly over the sizes
and the words taken come near the target; within a size class they are in the order of a digest, whose first bits cut it
into parts of about ``PART_ROWS``, however large the input: their counts are summed up, so that no task sorts a whole
source, and how many parts there are does not change the order.

Defined results: the size of a null text is 0; a null source is a source of its own, last in order; a source without
words has target 0 and gives nothing; null identifiers come first in their bucket; repeated rows count each for itself;
an empty table gives an empty result. Sizes are whole numbers, so targets and copies do not depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, running_rank, spread, words_of

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix has this share of all words.
SHARE = 1.5
#: No source's target is above this many times its size.
REPEATS = 2
#: Rows that a task may rank at once, and sources whose targets are broadcast.
PART_ROWS, MOST_SOURCES = 100_000, 100_000
SEED = "mix-1"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """From (missing, name, source_size), one row per source, the same with ``target``.

    Sources that reach ``repeats`` times their size first are those with the smallest size for their weight. In that
    order the excess is reshared by weight: source k is capped if the level that the sources from k on would get is at
    least its own. One row per source is few enough for one task.
    """
    order = Window.orderBy("missing", "name")
    listed = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = Window.orderBy(F.col("source_size") / F.col("_w"), "missing", "name")
    everything = Window.partitionBy()
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        listed.withColumn("_total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_used", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(repeats))
        .withColumn("_left_w", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_used")) / F.col("_left_w"))
        .withColumn("_capped", F.col("_level") * F.col("_w") >= F.col("source_size") * F.lit(repeats))
    )
    # the first source that is not capped fixes the level of all that follow
    final = level.withColumn("_final", F.min(F.when(~F.col("_capped"), F.struct(F.col("source_size") / F.col("_w"), "missing", "name", "_level"))).over(everything)["_level"])
    return final.select(
        "missing", "name", "source_size",
        F.when(F.col("_capped"), F.col("source_size") * F.lit(float(repeats))).otherwise(F.col("_final") * F.col("_w")).alias("target"),
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, part_rows: int = PART_ROWS, seed: str = SEED,
) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``copies``, ``taken``."""
    size = words_of(docs[text_col])
    rows = materialise(
        docs.select(
            docs[id_col].alias("_id"),
            docs[source_col].isNull().alias("missing"),
            F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("name"),
            size.alias("size"),
            spread(docs[id_col], 2**32).alias("digest"),
        )
        # eight classes for each doubling of the size
        .withColumn("_bits", F.length(F.bin(F.col("size") + 1)))
        .withColumn("class", F.col("_bits") * 8 + F.expr("shiftright((size + 1) * 8, _bits - 1)") - 8)
        .drop("_bits"),
        "mix",
    )
    sizes = materialise(rows.groupBy("missing", "name").agg(F.sum("size").alias("source_size")), "mix-sources")
    goals = targets(sizes, weights, share, repeats)
    if sizes.count() <= MOST_SOURCES:
        goals = F.broadcast(goals)
    bits = max(0, (rows.count() // part_rows).bit_length())
    parted = rows.withColumn("part", F.col("class") * 2**bits + F.shiftright("digest", 32 - bits))
    ranked = running_rank(parted, ["missing", "name"], "part", ["digest", "size", F.col("_id").asc_nulls_first()], "rank")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("name"), F.col("missing").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        ranked.join(goals, ["missing", "name"])
        .withColumn("_rate", rate)
        .withColumn("_u", offset)
        .withColumn("copies", (F.floor(F.col("rank") * F.col("_rate") + F.col("_u")) - F.floor((F.col("rank") - 1) * F.col("_rate") + F.col("_u"))).cast("long"))
        .select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
