"""Tables of a mapped scene: readers with explicit schemas, and a scene derived from the embeddings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import angles
from ..functions.taxonomy import TYPES
from ..functions.vectors import doubles

_CONTEXT = "array<struct<label:string,attributes:array<string>,distance_from_primary_m:double,distance_from_camera_m:double,relative_height_from_camera_m:double,relative_bearing_deg:double,estimated_global_x:double,estimated_global_y:double,estimated_global_z:double,relation_to_primary:string>>"
VIEWS = "id long, x double, y double, world_position array<double>, orientation int, file_name string, parse_status string, frame_text_short string, frame_text_long string, room_function string, view_type string, attribute struct<view_type:string,room_function:string,style_hint:string,clutter_level:string,floor_pattern:string,lighting_ceiling:string,wall_color:string,scene_attributes:array<string>,additional_notes:string,image_summary:string>"
OBSERVATIONS = f"object_global_id long, entry_id long, view_id string, file_name string, label string, description string, long_form_open_description string, text_input_for_clip_short string, text_input_for_clip_long string, object_text_short string, object_text_long string, laterality string, distance_bin string, verticality string, distance_from_camera_m double, relative_bearing_deg double, relative_height_from_camera_m double, object_orientation_deg double, estimated_global_x double, estimated_global_y double, estimated_global_z double, surrounding_context {_CONTEXT}, location_relative_to_other_objects string, parse_status string, object_confidence double"
PAIRS = "pair_id string, db_dir string, obj_a_id long, obj_b_id long, is_same_instance boolean, split string, notes string, annotator string, created_at string"


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped; a malformed line raises, or is dropped if not ``strict``."""
    return spark.read.schema(_schema(schema)).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_jsonl_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same, empty if there is no such file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], _schema(schema))
    return read_jsonl(spark, path, schema)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, vec) of a two-dimensional NPY file, read in blocks of rows by the executors."""
    import io

    import numpy as np
    import pandas as pd

    def rows(batches):
        for batch in batches:
            for content in batch["content"]:
                m = np.load(io.BytesIO(content), allow_pickle=False)
                for i in range(0, len(m), 4096):
                    yield pd.DataFrame({"row_idx": np.arange(i, min(len(m), i + 4096)), "vec": list(m[i : i + 4096].astype(np.float32))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "row_idx long, vec array<float>")


def check(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """Raises if any row is bad."""
    if not df.where(bad).isEmpty():
        raise ValueError(message)
    return df


def attach_vectors(rows: DataFrame, vectors: DataFrame, position: str = "row_idx") -> DataFrame:
    """Row i of the table gets row i of the matrix; unequal counts or dimensions raise."""
    if rows.count() != vectors.count():
        raise ValueError("table and matrix differ in rows")
    if vectors.select(F.size("vec")).distinct().count() > 1:
        raise ValueError("vectors differ in dimensions")
    return rows.join(vectors, position)


def write_once(df: DataFrame, path: str, keys: list[str], order: Column) -> None:
    """Idempotent keyed write: of rows with one key the last by ``order`` stays."""
    others = [c for c in df.columns if c not in keys]
    df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*").write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_matrix_csv(cells: DataFrame, row: str, column: str, value: str, path: str, labels: list[str]) -> None:
    """A square labelled matrix with six decimals; ``labels`` fixes the columns."""
    wide = cells.withColumn(value, F.format_string("%.6f", value)).groupBy(row).pivot(column, labels).agg(F.first(value))
    wide.orderBy(row).coalesce(1).write.mode("overwrite").csv(path, header=True)


def scan_angles(report_top: Column, report_random: Column, orientations: Column) -> Column:
    """Angles of a build report, or else those seen."""
    listed = F.array_union(F.coalesce(report_top, F.array().cast("array<int>")), F.coalesce(report_random, F.array().cast("array<int>")))
    return angles.scan_angles(F.when(F.size(listed) > 0, listed).otherwise(orientations))


def derived_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of a made-up scene: six objects a view, four views a place, places on a grid two metres apart."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    i = F.col("vec_id")
    rows = e.select(
        i.alias("object_global_id"), F.expr("vec_id DIV 6").alias("entry_id"), F.expr("vec_id DIV 24").alias("place_no"),
        F.expr("cast((vec_id DIV 6) % 4 * 90 as int)").alias("orientation"),
        F.element_at(F.array(*map(F.lit, TYPES[:10])), F.col("label") + 1).alias("label"), F.col("label").alias("label_no"),
        F.when(i % 17 != 0, (5 + (i * 37) % 40) / 10).alias("distance_m"),
        ((i * 53) % 81 - 40).cast("double").alias("bearing_deg"), (((i * 29) % 21 - 10) / 10).alias("height_m"),
        doubles(F.col("embedding")).alias("vec"),
    ).withColumns({
        "x": F.expr("cast(place_no % 5 * 2 as double)"), "z": F.expr("cast(place_no DIV 5 * 2 as double)"),
        "view_id": F.format_string("view_%05d", "entry_id"), "place_id": F.format_string("place_%05d", "place_no"),
        "laterality": F.when(F.col("bearing_deg") < -13, "left").when(F.col("bearing_deg") > 13, "right").otherwise("center"),
        "distance_bin": F.when(F.col("distance_m") < 1.5, "near").when(F.col("distance_m") >= 4, "far").otherwise("middle"),
        "verticality": F.when(F.col("height_m") > 0.25, "high").when(F.col("height_m") < -0.25, "low").otherwise("middle"),
        "description": F.concat(F.col("label"), F.lit(" of kind "), F.col("object_global_id") % 7, F.when(F.col("object_global_id") % 11 == 0, " seen in mirror").otherwise("")),
    })
    gx, gz = angles.project_from_camera(F.col("x"), F.col("z"), F.col("orientation"), F.col("bearing_deg"), F.col("distance_m"))
    return rows.withColumns({"gx": gx, "gy": F.when(F.col("distance_m").isNotNull(), F.col("height_m")), "gz": gz})


def derived_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, view_id, place_no, x, z, orientation, room_function, view_type), one row per view."""
    rooms = F.array(*map(F.lit, ("cooking", "resting", "dining")))
    kinds = F.array(*map(F.lit, ("kitchen", "bedroom")))
    return derived_observations(spark, sf_dir).select(F.col("entry_id").alias("id"), "view_id", "place_no", "x", "z", "orientation").distinct().withColumns({
        "room_function": F.element_at(rooms, (F.col("id") % 3 + 1).cast("int")), "view_type": F.element_at(kinds, (F.col("place_no") % 2 + 1).cast("int")),
    })


#: The same scene for the oracle.
OBS_SQL = """obs AS (
  SELECT *, CASE WHEN distance_m IS NOT NULL THEN x - sin(radians(orientation - bearing_deg)) * distance_m END AS gx,
    CASE WHEN distance_m IS NOT NULL THEN height_m END AS gy,
    CASE WHEN distance_m IS NOT NULL THEN z - cos(radians(orientation - bearing_deg)) * distance_m END AS gz
  FROM (
    SELECT vec_id AS object_global_id, vec_id // 6 AS entry_id, vec_id // 24 AS place_no, (vec_id // 6 % 4 * 90)::INT AS orientation,
      ['door','window','blinds','mirror','clock','stairs','railing','art','picture frame','plant'][label + 1] AS label, label AS label_no,
      CASE WHEN vec_id % 17 <> 0 THEN (5 + (vec_id * 37) % 40) / 10::DOUBLE END AS distance_m,
      ((vec_id * 53) % 81 - 40)::DOUBLE AS bearing_deg, ((vec_id * 29) % 21 - 10) / 10::DOUBLE AS height_m,
      embedding::DOUBLE[] AS vec, (vec_id // 24 % 5 * 2)::DOUBLE AS x, (vec_id // 24 // 5 * 2)::DOUBLE AS z,
      'view_' || lpad((vec_id // 6)::VARCHAR, 5, '0') AS view_id, 'place_' || lpad((vec_id // 24)::VARCHAR, 5, '0') AS place_id,
      CASE WHEN (vec_id * 53) % 81 - 40 < -13 THEN 'left' WHEN (vec_id * 53) % 81 - 40 > 13 THEN 'right' ELSE 'center' END AS laterality,
      CASE WHEN vec_id % 17 = 0 THEN 'middle' WHEN 5 + (vec_id * 37) % 40 < 15 THEN 'near' WHEN 5 + (vec_id * 37) % 40 >= 40 THEN 'far' ELSE 'middle' END AS distance_bin,
      CASE WHEN (vec_id * 29) % 21 - 10 > 2 THEN 'high' WHEN (vec_id * 29) % 21 - 10 < -2 THEN 'low' ELSE 'middle' END AS verticality,
      ['door','window','blinds','mirror','clock','stairs','railing','art','picture frame','plant'][label + 1] || ' of kind ' || vec_id % 7 || CASE WHEN vec_id % 11 = 0 THEN ' seen in mirror' ELSE '' END AS description
    FROM embeddings)),
views AS (SELECT DISTINCT entry_id AS id, view_id, place_no, x, z, orientation, ['cooking','resting','dining'][entry_id % 3 + 1] AS room_function, ['kitchen','bedroom'][place_no % 2 + 1] AS view_type FROM obs)"""
