"""Regions and tours of a navigable grid (ix, iz)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components


def grid_regions(cells: DataFrame) -> DataFrame:
    """(ix, iz, region, size): cells joined by their four neighbours; regions are named by their first cell, x before z."""
    wide = 2**31
    key = lambda x, z: ((x + wide // 2) * wide + z + wide // 2).cast("long")
    keyed = cells.select("ix", "iz").distinct().withColumn("cell", key(F.col("ix"), F.col("iz")))
    steps = F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dz")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dz")))
    ahead = keyed.withColumn("s", F.explode(steps)).select("cell", key(F.col("ix") + F.col("s.dx"), F.col("iz") + F.col("s.dz")).alias("next"))
    links = ahead.join(keyed.select(F.col("cell").alias("next")), "next")
    found = keyed.join(connected_components(links, "cell", "next"), keyed["cell"] == F.col("node"), "left")
    named = found.select("ix", "iz", F.coalesce("component", "cell").alias("region"))
    return named.join(named.groupBy("region").agg(F.count(F.lit(1)).alias("size")), "region")


def swept(regions: DataFrame) -> DataFrame:
    """Adds ``visit``: a region's cells row by row along its longer side, every other row backwards."""
    by = Window.partitionBy("region")
    span = lambda c: F.max(c).over(by) - F.min(c).over(by)
    rows = regions.withColumn("_wide", span("ix") >= span("iz"))
    rows = rows.withColumns({"_line": F.when(F.col("_wide"), F.col("iz")).otherwise(F.col("ix")), "_along": F.when(F.col("_wide"), F.col("ix")).otherwise(F.col("iz"))})
    rows = rows.withColumn("_no", F.dense_rank().over(by.orderBy("_line")) - 1)
    along = F.when(F.col("_no") % 2 == 0, F.col("_along")).otherwise(-F.col("_along"))
    return rows.withColumn("visit", F.row_number().over(by.orderBy("_no", along)) - 1).drop("_wide", "_line", "_along", "_no")


def resampled(path: DataFrame, key: str, order: str, step: float) -> DataFrame:
    """(key, n, x, z): points every ``step`` metres along each path of points (x, z), its start and end included."""
    by = Window.partitionBy(key).orderBy(order)
    leg = F.hypot(F.col("x") - F.lag("x").over(by), F.col("z") - F.lag("z").over(by))
    rows = path.withColumn("_leg", F.coalesce(leg, F.lit(0.0)))
    rows = rows.withColumns({"_end": F.sum("_leg").over(by), "_px": F.lag("x").over(by), "_pz": F.lag("z").over(by), "_last": F.lead(order).over(by).isNull()})
    first, last = F.ceil(F.bround((F.col("_end") - F.col("_leg")) / step, 9)), F.ceil(F.bround(F.col("_end") / step, 9)) - 1
    whole: Column = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    inner = rows.where("_leg > 0").select(key, "_leg", "_end", "_px", "_pz", "x", "z", F.explode(whole).alias("n"))
    t = (F.col("n") * step - (F.col("_end") - F.col("_leg"))) / F.col("_leg")
    points = inner.select(key, "n", (F.col("_px") + t * (F.col("x") - F.col("_px"))).alias("x"), (F.col("_pz") + t * (F.col("z") - F.col("_pz"))).alias("z"))
    ends = rows.where("_last").select(key, F.ceil(F.bround(F.col("_end") / step, 9)).alias("n"), "x", "z")
    return points.unionByName(ends)
