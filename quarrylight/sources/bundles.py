"""Whole scene databases on disk: loading with checks, resuming, growing memories, and result bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles
from ..operators.clustering import plain_laplacian
from .scenes import OBSERVATIONS, VIEWS, attach_vectors, read_jsonl, read_matrix

REQUIRED = ("id", "x", "y", "orientation", "file_name")
TEXT_MODES = ("short", "long")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def numbered(rows: DataFrame, name: str = "row_idx") -> DataFrame:
    """Rows with their place in the file, from 0: counts of the partitions' rows are summed up, nothing is sorted."""
    placed = rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}  # one row for each partition
    begin, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        begin.append(total)
        total += counts.get(part, 0)
    start = F.element_at(F.array(*map(F.lit, begin or [0])), F.col("_part") + 1)
    return placed.withColumn(name, (start + F.col("_at").bitwiseAND(F.lit(2**33 - 1))).cast("long")).drop("_part", "_at")


def load_views(spark: SparkSession, folder: str, mode: str = "short", meta: str = "meta.jsonl") -> DataFrame:
    """Views with ``image_vec`` and ``text_vec``; raises if a file or field is missing, or counts or dimensions differ."""
    if mode not in TEXT_MODES:
        raise ValueError(f"no such text mode: {mode}")
    paths = [f"{folder}/{n}" for n in (meta, "image_emb.npy", f"text_emb_{mode}.npy")]
    for p in paths:
        if not exists(spark, p):
            raise FileNotFoundError(p)
    rows = numbered(read_jsonl(spark, paths[0], VIEWS))
    missing = rows.agg(*(F.sum(F.col(c).isNull().cast("int")).alias(c) for c in REQUIRED)).first().asDict()
    if any(missing.values()):
        raise ValueError(f"fields missing in some rows: {sorted(c for c, n in missing.items() if n)}")
    image, text = read_matrix(spark, paths[1]), read_matrix(spark, paths[2])
    if (dims := {t.select(F.size("vec").alias("d")).first() for t in (image, text)} - {None}) and len(dims) > 1:
        raise ValueError("image and text vectors differ in dimensions")
    with_image = attach_vectors(rows, image).withColumnRenamed("vec", "image_vec")
    return attach_vectors(with_image, text).withColumnRenamed("vec", "text_vec")


def load_objects(spark: SparkSession, folder: str, mode: str = "short", meta: str = "object_meta.jsonl") -> DataFrame | None:
    """Objects with ``vec``; null if either file is not there."""
    if mode not in TEXT_MODES:
        raise ValueError(f"no such text mode: {mode}")
    paths = f"{folder}/{meta}", f"{folder}/object_text_emb_{mode}.npy"
    if not all(exists(spark, p) for p in paths):
        return None
    return attach_vectors(numbered(read_jsonl(spark, paths[0], OBSERVATIONS)), read_matrix(spark, paths[1]))


def entry_index(objects: DataFrame) -> DataFrame:
    """(entry_id, rows): where the objects of each entry stand; negative entries are left out."""
    return objects.where("entry_id >= 0").groupBy("entry_id").agg(F.array_sort(F.collect_list("row_idx")).alias("rows"))


def resumed(spark: SparkSession, folder: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Views and objects of an earlier run; all or nothing: none if the views do not stand at their own identifiers."""
    try:
        views = load_views(spark, folder)
    except (FileNotFoundError, ValueError):
        return None, None
    if not views.where("id <> row_idx").isEmpty():
        return None, None
    return views, load_objects(spark, folder)


def first_angles(*candidates: Column, default: tuple[int, ...] = (0, 90, 180, 270)) -> Column:
    """Scan angles of the first candidate that has any, else the default."""
    found = [F.when(F.size(angles.scan_angles(c)) > 0, angles.scan_angles(c)) for c in candidates]
    return F.coalesce(*found, F.array(*map(F.lit, default)))


def first_projection(*sources: DataFrame) -> DataFrame:
    """Bounds (min_x, max_x, min_z, max_z) of the first source that has a row with all: saved, of the scene, of the rows."""
    columns = ["min_x", "max_x", "min_z", "max_z"]
    ranked = None
    for i, s in enumerate(sources):
        one = s.select(*columns, F.lit(i).alias("_source"))
        ranked = one if ranked is None else ranked.unionByName(one)
    whole = ranked.where(" and ".join(f"{c} is not null" for c in columns))
    return whole.orderBy("_source").limit(1).drop("_source")


def backfill_projection(spark: SparkSession, path: str, bounds: DataFrame, overwrite: bool = False) -> str:
    """Writes the bounds unless they are there: "exists" or "written"."""
    if exists(spark, path) and not overwrite:
        return "exists"
    bounds.write.mode("overwrite").json(path)
    return "written"


def newest_queries(spark: SparkSession, folder: str, crop: str = "query_object_crop.jpg", limit: int | None = None) -> DataFrame:
    """(crop_path, query_dir, query_json_path): every crop below a folder with the last query file next to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("query_dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    last = files.where(F.col("name").rlike("^query_.*\\.json$")).groupBy("query_dir").agg(F.max("path").alias("query_json_path"))
    jobs = files.where(F.col("name") == crop).select(F.col("path").alias("crop_path"), "query_dir").join(last, "query_dir", "left")
    return jobs.orderBy("crop_path").limit(limit) if limit and limit > 0 else jobs


class Memory:
    """A growing table of (id, vec, meta) in a folder: every ``add`` appends files, ``load`` reads them all."""

    SCHEMA = "id long, vec array<float>, meta string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, rows: DataFrame) -> None:
        rows.select("id", F.col("vec").cast("array<float>").alias("vec"), "meta").write.mode("append").parquet(self.path)

    def load(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], self.SCHEMA)

    def save(self, path: str) -> None:
        self.load().write.mode("overwrite").parquet(path)

    def reset(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def merge_keyed(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], shared_dir: str) -> None:
    """Upsert: rows with a known key are set to the new values where those are not null, others are added.

    A key that the new rows repeat, or that is null, raises. The table is written beside itself first, in the shared
    folder, since it cannot be read and replaced at once.
    """
    if not rows.where(" or ".join(f"`{k}` is null" for k in keys)).isEmpty() or not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"keys {keys} are null or repeat")
    merged = rows
    if exists(spark, path):
        old = spark.read.parquet(path)
        marked = rows.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in rows.columns if c not in keys))
        both = old.join(marked, keys, "full")
        others = [c for c in dict.fromkeys([*old.columns, *rows.columns]) if c not in keys]
        pick = lambda c: F.coalesce(*(F.col(x) for x in (f"_n_{c}", c) if x in both.columns)).alias(c)
        merged = both.select(*keys, *map(pick, others))
    beside = f"{shared_dir.rstrip('/')}/merge-{abs(hash(path))}"
    merged.write.mode("overwrite").parquet(beside)
    spark.read.schema(merged.schema).parquet(beside).write.mode("overwrite").parquet(path)


def rectangular(cells: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A labelled matrix whose rows and columns differ, with six decimals; missing cells are 0."""
    wide = cells.groupBy(row).pivot(column, columns).agg(F.first(value))
    return wide.select(row, *(F.format_string("%.6f", F.coalesce(F.col(f"`{c}`"), F.lit(0.0))).alias(c) for c in columns))


def write_rectangular_csv(cells: DataFrame, row: str, column: str, value: str, path: str, columns: list[str]) -> None:
    rectangular(cells, row, column, value, columns).orderBy(row).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_pairs_csv(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """Each row as one JSON object of plain values; vectors become lists, nulls are written."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def summary_markdown(metrics: DataFrame, columns: list[str], digits: int = 4) -> str:
    """A table of metrics (one row for each representation, ``rep``); a missing figure is n/a."""
    lines = ["| Representation | " + " | ".join(columns) + " |", "| --- |" + " ---: |" * len(columns)]
    for r in metrics.select("rep", *columns).orderBy("rep").collect():  # one row for each representation
        lines.append(f"| {r['rep']} | " + " | ".join("n/a" if r[c] is None else f"{r[c]:.{digits}f}" for c in columns) + " |")
    return "\n".join(lines) + "\n"


def laplacians(affinity: DataFrame, group: str, value: str = "affinity") -> DataFrame:
    """(group, i, j, value) of each group's normalised Laplacian, the diagonal of the affinity left out."""
    import numpy as np
    import pandas as pd

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf[["i", "j"]].to_numpy())
        at = {x: n for n, x in enumerate(ids)}
        a = np.zeros((len(ids), len(ids)))
        i, j = pdf["i"].map(at).to_numpy(), pdf["j"].map(at).to_numpy()
        a[i, j] = a[j, i] = pdf[value].to_numpy()
        out = plain_laplacian(a)
        return pd.DataFrame({group: key[0], "i": np.repeat(ids, len(ids)), "j": np.tile(ids, len(ids)), "value": out.ravel()})

    return affinity.select(group, "i", "j", value).groupBy(group).applyInPandas(run, f"{group} string, i long, j long, value double")


def write_clusters(path: str, group: str, **tables: DataFrame) -> None:
    """A result bundle: every table under its own name, cut by group."""
    for name, table in tables.items():
        table.write.mode("overwrite").partitionBy(group).parquet(f"{path}/{name}")
