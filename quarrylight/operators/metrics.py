"""Ranking and classification metrics as windows and conditional sums.

Scores of one representation are one group; ``rep`` names it, so many are measured in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def roc_auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, label 0/1, score): the AUC by average ranks; null if a class is missing.

    Ranks come from the counts of distinct scores, so rows are combined before they are ordered.
    """
    counts = scored.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.coalesce(F.sum("n").over(upto), F.lit(0)) + (F.col("n") + 1) / 2)
    total = ranked.groupBy(*keys).agg(F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"), F.sum(F.col("rank") * F.col("p")).alias("s"))
    return total.select(*keys, "pos", "neg", F.when((F.col("pos") > 0) & (F.col("neg") > 0), (F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))).alias("auc"))


def average_precision(scored: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Mean precision at the positives, by score, ties in the order of ``position`` and then negatives first.

    Counts of distinct scores are summed up; only rows of one score are ranked among themselves.
    """
    counts = scored.groupBy(*keys, "score").agg(F.sum("label").alias("_p"), F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "score", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n"))
    order = Window.partitionBy(*keys, "score").orderBy(position, "label")
    hits = F.col("_p") + F.sum("label").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = scored.join(starts, [*keys, "score"]).withColumns({"_r": F.col("_n") + F.row_number().over(order), "_hit": hits})
    return ranked.groupBy(*keys).agg((F.sum(F.when(F.col("label") == 1, F.col("_hit") / F.col("_r"))) / F.sum("label")).alias("ap"))


def threshold_stats(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates when all from a score on are called positive, for each distinct score and one below all."""
    counts = scored.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
    from_here = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*keys)
    at = counts.select(*keys, F.col("score").alias("threshold"), F.sum("p").over(from_here).alias("tp"), F.sum("n").over(from_here).alias("called"), F.sum("p").over(every).alias("pos"), F.sum("n").over(every).alias("all"))
    below = counts.groupBy(*keys).agg((F.min("score") - 1e-6).alias("threshold"), F.sum("p").alias("tp"), F.sum("n").alias("called"), F.sum("p").alias("pos"), F.sum("n").alias("all"))
    t = at.unionByName(below)
    fp, fn = F.col("called") - F.col("tp"), F.col("pos") - F.col("tp")
    precision = F.when(F.col("called") > 0, F.col("tp") / F.col("called")).otherwise(0.0)
    recall = F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0)
    return t.withColumns({"fp": fp, "fn": fn, "precision": precision, "recall": recall}).withColumns({
        "f1": F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0),
        "accuracy": (F.col("all") - F.col("fp") - F.col("fn")) / F.col("all"),
    })


def best_threshold(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold with the best F1, then accuracy, then the smallest."""
    order = F.struct(-F.col("f1"), -F.col("accuracy"), "threshold")
    return threshold_stats(scored, keys).groupBy(*keys).agg(F.min_by(F.struct("threshold", "f1", "accuracy", "precision", "recall", "tp", "fp", "fn"), order).alias("_b")).select(*keys, "_b.*")


def retrieval(scored: DataFrame, keys: list[str]) -> DataFrame:
    """From pairs (a, b, label, score): each object with a positive ranks its partners; recall at 1 and 5, and MRR."""
    both = scored.select(*keys, F.col("a").alias("anchor"), F.col("b").alias("other"), "label", "score").unionByName(scored.select(*keys, F.col("b").alias("anchor"), F.col("a").alias("other"), "label", "score"))
    order = Window.partitionBy(*keys, "anchor").orderBy(F.desc("score"), "other")
    first = both.withColumn("_r", F.row_number().over(order)).where("label = 1").groupBy(*keys, "anchor").agg(F.min("_r").alias("r"))
    return first.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("anchors"), F.avg((F.col("r") <= 1).cast("double")).alias("recall_1"), F.avg((F.col("r") <= 5).cast("double")).alias("recall_5"), F.avg(1 / F.col("r")).alias("mrr")
    )


def means_by_class(scored: DataFrame, keys: list[str]) -> DataFrame:
    pos, neg = (F.when(F.col("label") == k, F.col("score")) for k in (1, 0))
    return scored.groupBy(*keys).agg(F.avg(pos).alias("mean_pos"), F.avg(neg).alias("mean_neg"), F.median(pos).alias("median_pos"), F.median(neg).alias("median_neg"), F.count(F.lit(1)).alias("n"))


def errors(df: DataFrame, distance: str, yaw: str) -> DataFrame:
    """Localisation errors of a batch: mean, median and 90th percentile distance, mean yaw."""
    return df.agg(F.avg(distance).alias("mean_m"), F.median(distance).alias("median_m"), F.percentile(distance, F.lit(0.9)).alias("p90_m"), F.avg(yaw).alias("mean_yaw"), F.count(F.lit(1)).alias("n"))


def set_metrics(df: DataFrame, truth: str, found: str) -> DataFrame:
    """True and false positives and misses of two arrays; two empty ones agree wholly."""
    t, p = F.array_distinct(truth), F.array_distinct(found)
    both, either = F.size(F.array_intersect(t, p)), F.size(F.array_union(t, p))
    return df.withColumns({
        "tp": both, "fp": F.size(F.array_except(p, t)), "fn": F.size(F.array_except(t, p)),
        "jaccard": F.when(either == 0, 1.0).otherwise(both / either), "hit": (both > 0) | (either == 0),
    })


def set_summary(measured: DataFrame) -> DataFrame:
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return measured.agg(F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("micro_f1"), F.avg("jaccard").alias("mean_jaccard"), F.avg(F.col("hit").cast("double")).alias("accuracy"))


def normalised_pairs(pairs: DataFrame, split: str | None = None) -> DataFrame:
    """Labelled pairs with the smaller id first, one for each (database, a, b); an own pair or a contradiction raises."""
    if not pairs.where("obj_a_id = obj_b_id").isEmpty():
        raise ValueError("a pair of an object with itself")
    rows = pairs if split is None else pairs.where(F.coalesce("split", F.lit("dev")) == split)
    rows = rows.select(F.regexp_extract("db_dir", "([^/]+)/*$", 1).alias("db"), F.least("obj_a_id", "obj_b_id").alias("a"), F.greatest("obj_a_id", "obj_b_id").alias("b"), "pair_id", F.col("is_same_instance").cast("int").alias("label"))
    one = rows.groupBy("db", "a", "b").agg(F.min("pair_id").alias("pair_id"), F.min("label").alias("label"), F.max("label").alias("_m"))
    if not one.where("label <> _m").isEmpty():
        raise ValueError("pairs that contradict each other")
    return one.drop("_m")
