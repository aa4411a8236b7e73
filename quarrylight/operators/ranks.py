"""Numbers from 0 over a whole table, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS = 4096


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """Adds ``out``: the place of a row in the order of the distinct whole numbers ``key``, from 0.

    The range of the key is cut into ``PARTS``; their counts, which are as few, are summed up, and each part numbers its
    own rows.
    """
    ends = df.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    low, width = ends["a"] or 0, max(1, -(-((ends["b"] or 0) - (ends["a"] or 0) + 1) // PARTS))
    parted = df.withColumn("_part", F.floor((F.col(key) - low) / width).cast("int"))
    counts = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return parted.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + own - 1).drop("_part", "_start")
