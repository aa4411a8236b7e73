"""Detections and masked depth: filters and statistics of tabular model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clamped(box: tuple[Column, ...], width: Column, height: Column) -> tuple[Column, ...]:
    """A box (x1, y1, x2, y2) in whole pixels within the image, its corners in order."""
    put = lambda v, most: F.greatest(F.lit(0), F.least(F.bround(v, 0).cast("int"), most - 1))
    x1, y1, x2, y2 = (put(v, m) for v, m in zip(box, (width, height, width, height)))
    return F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)


def valid_detections(df: DataFrame, least_confidence: float = 0.35, least_side: int = 32, least_area: float = 0.005, most_area: float = 0.60) -> DataFrame:
    """Detections (label, confidence, x1, y1, x2, y2, width, height) that are sure, not thin, and of a sensible size."""
    x1, y1, x2, y2 = clamped(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("width"), F.col("height"))
    rows = df.where(F.col("confidence") >= least_confidence).withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    share = w * h / (F.col("width") * F.col("height"))
    return rows.withColumns({"box_w": w, "box_h": h, "area_ratio": share}).where((w >= least_side) & (h >= least_side) & (share >= least_area) & (share <= most_area))


def padded(df: DataFrame, share: float = 0.1) -> DataFrame:
    """Boxes widened by a share of their sides, within the image."""
    px, py = (F.bround((F.col(b) - F.col(a)) * share, 0).cast("int") for a, b in (("x1", "x2"), ("y1", "y2")))
    return df.withColumns({"x1": F.greatest(F.lit(0), F.col("x1") - px), "y1": F.greatest(F.lit(0), F.col("y1") - py), "x2": F.least(F.col("width"), F.col("x2") + px), "y2": F.least(F.col("height"), F.col("y2") + py)})


def box_laterality(x1: Column, x2: Column, width: Column) -> Column:
    """By exact thirds of the image."""
    c = (x1 + x2) / 2
    return F.when(c < width / 3, "left").when(c > width * 2 / 3, "right").otherwise("center")


def normalised_box(df: DataFrame) -> DataFrame:
    """(x, y, w, h) in shares of the image."""
    return df.withColumns({"nx": F.col("x1") / F.col("width"), "ny": F.col("y1") / F.col("height"), "nw": (F.col("x2") - F.col("x1")) / F.col("width"), "nh": (F.col("y2") - F.col("y1")) / F.col("height")})


def depth_statistics(pixels: DataFrame, keys: list[str], depth: str = "depth_m", trim: float = 0.1) -> DataFrame:
    """Of the finite depths above 0: count, median, median without a tenth at each end, 10th and 90th percentile."""
    good = pixels.where(F.col(depth).isNotNull() & ~F.isnan(depth) & (F.col(depth) > 0) & (F.col(depth) < float("inf")))
    by = Window.partitionBy(*keys)
    n, k = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy(depth))
    ranked = good.withColumns({"_n": n, "_k": k}).withColumn("_cut", F.floor(F.col("_n") * trim))
    inner = F.when((F.col("_n") <= 2 * F.col("_cut")) | ((F.col("_k") > F.col("_cut")) & (F.col("_k") <= F.col("_n") - F.col("_cut"))), F.col(depth))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median(depth).alias("median"), F.median(inner).alias("trimmed_median"), F.percentile(depth, F.lit(0.1)).alias("p10"), F.percentile(depth, F.lit(0.9)).alias("p90"))
