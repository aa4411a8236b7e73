"""What the corpus operators share: tables, shared storage, distributed ranks, hash splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import delete_on_exit, drop, materialise, shared_dir  # noqa: F401  (for the operators)

#: `[\x20\x09-\x0D]` in a form that the JVM's and DuckDB's regular expressions both read.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def words_of(text: Column) -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread(key: Column, buckets: int) -> Column:
    """A bucket from 0 that follows from ``key`` alone, the same in every engine that has MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int" if buckets <= 2**31 else "long")


def running_rank(df: DataFrame, groups: list[str], part: str, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: a gapless rank from 1 within ``groups``, by ``part`` and then ``order``.

    A group may hold a third of all rows, so no task sorts a whole group: rows are counted for each (group, part), the
    counts are summed up over the parts, and each (group, part) ranks its own rows from there. ``groups`` and ``part``
    must not be null; ``df`` should be a stored table, as it is read twice.
    """
    keys = [*groups, part]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.join(starts, keys)
        .withColumn(out, F.col("_start") + F.row_number().over(within))
        .drop("_start")
    )


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``; null for a null identifier."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))
