"""Records as the builder writes them: object records with all defaults, enriched contexts, detections, query texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles
from ..functions.taxonomy import canonical_label
from ..functions.texts import MAX_SURROUNDINGS, safe_or, safe_text

# Columns of an object record that stay as they are given, with their types.
MEASURES = {
    "distance_from_camera_m": "double", "relative_height_from_camera_m": "double", "relative_bearing_deg": "double",
    "estimated_global_x": "double", "estimated_global_y": "double", "estimated_global_z": "double",
    "geometry_fallback_reason": "string", "detector_label": "string", "detector_confidence": "double",
    "mask_area_px": "long", "mask_area_ratio": "double", "mask_centroid_x_px": "double", "mask_centroid_y_px": "double",
    "mask_centroid_x_norm": "double", "mask_centroid_y_norm": "double", "depth_stat_median_m": "double", "depth_stat_p10_m": "double",
    "depth_stat_p90_m": "double", "projected_planar_distance_m": "double", "vertical_angle_deg": "double",
    "vlm_distance_from_camera_m": "double", "vlm_relative_bearing_deg": "double",
    "crop_path": "string", "mask_path": "string", "mask_overlay_path": "string", "depth_map_path": "string", "crop_vlm_label": "string",
}
# Texts of an object record and what they are when missing.
TEXTS = {
    "description": "", "long_form_open_description": "", "laterality": "center", "distance_bin": "middle", "verticality": "middle", "any_text": "",
    "location_relative_to_other_objects": "", "object_text_short": "unknown", "object_text_long": "unknown", "geometry_source": "vlm_fallback",
}
# Shares of the image's sides where an object without a box is marked.
ANCHOR_X = {"left": 0.18, "center": 0.50, "right": 0.82}
ANCHOR_Y = {"high": 0.18, "middle": 0.50, "low": 0.82}


def _given(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _clean(df: DataFrame, name: str) -> Column:
    listed = F.coalesce(_given(df, name, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(listed, lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != "")


def object_records(objects: DataFrame, step: int = 30, split: bool = True, by_bearing: bool = False, variant: str = "angle_split") -> DataFrame:
    """The whole record of each object; columns that are missing or null get their defaults.

    The object's direction is the camera's, moved by its side, or by its bearing if asked and known.
    """
    text = {c: F.coalesce(_given(objects, c, "string"), F.lit(d)) for c, d in TEXTS.items()}
    bucket = F.when(F.lower(text["laterality"]).isin("left", "center", "right"), F.lower(text["laterality"])).otherwise("center") if split else F.lit("center")
    by_side = angles.object_orientation(F.col("orientation"), bucket, float(step)).cast("int")
    bearing = _given(objects, "relative_bearing_deg", "double")
    exact = F.pmod(F.bround(angles.wrap360(F.col("orientation") - bearing), 0).cast("int"), F.lit(360))
    boxes = _given(objects, "bbox_xywh_norm", "array<double>"), _given(objects, "bbox_xyxy", "array<double>")
    zeros = F.array(*(F.lit(0.0),) * 4)
    return objects.select(
        "object_global_id", *(F.coalesce(_given(objects, c, "int"), F.col("entry_id").cast("int")).alias(c) for c in ("frame_id",)), F.col("entry_id").cast("int").alias("entry_id"),
        _given(objects, "file_name", "string").alias("file_name"), "x", "z", F.array("x", F.coalesce(_given(objects, "camera_y", "double"), F.lit(0.0)), "z").alias("world_position"),
        F.col("orientation").cast("int").alias("orientation"), F.col("orientation").cast("int").alias("frame_orientation"),
        (F.when(bearing.isNotNull(), exact).otherwise(by_side) if by_bearing else by_side).alias("object_orientation_deg"),
        bucket.alias("angle_bucket"), F.lit(step).alias("angle_split_step_deg"), F.lit(variant).alias("builder_variant"),
        F.coalesce(_given(objects, "object_local_id", "string"), F.format_string("obj_%03d", F.col("object_global_id"))).alias("object_local_id"),
        F.coalesce("label", F.lit("unknown")).alias("label"), F.coalesce(_given(objects, "object_confidence", "double"), F.lit(0.0)).alias("object_confidence"),
        F.slice(F.coalesce(boxes[0], zeros), 1, 4).alias("bbox_xywh_norm"), F.slice(F.coalesce(boxes[1], F.array().cast("array<double>")), 1, 4).alias("bbox_xyxy"),
        F.lit("unknown").alias("facing"), F.lit(0.0).alias("orientation_confidence"), *(c.alias(n) for n, c in text.items()),
        text["object_text_short"].alias("text_input_for_clip_short"), text["object_text_long"].alias("text_input_for_clip_long"),
        _clean(objects, "attributes").alias("attributes"), _clean(objects, "scene_attributes").alias("scene_attributes"),
        F.coalesce(_given(objects, "parse_status", "string"), F.lit("unknown")).alias("parse_status"),
        *(_given(objects, c, kind).alias(c) for c, kind in MEASURES.items()),
        *(_given(objects, c, "string").alias(c) for c in ("view_type", "room_function", "style_hint", "clutter_level")),
    )


def enriched(objects: DataFrame, context: str = "surrounding_context", step: int = 30) -> DataFrame:
    """Objects and the first surroundings of each with bearings that are valid and positions projected from the camera.

    Objects: x, z, camera_y, orientation, laterality, distance_m, bearing_deg, height_m and an array of structs with
    label, distance_m, bearing_deg, height_m, relation. A missing bearing of an object with a distance follows its side.
    """
    bearing = F.coalesce(angles.valid_bearing(F.col("bearing_deg")), F.when(F.col("distance_m").isNotNull(), angles.fallback_bearing(F.col("laterality"), float(step))))
    rows = objects.withColumn("bearing_deg", bearing)
    x, z = angles.project_from_camera(F.col("x"), F.col("z"), F.col("orientation"), F.col("bearing_deg"), F.col("distance_m"))

    def near(c: Column) -> Column:
        b = angles.valid_bearing(c["bearing_deg"])
        cx, cz = angles.project_from_camera(F.col("x"), F.col("z"), F.col("orientation"), b, c["distance_m"])
        return F.struct(c["label"].alias("label"), c["distance_m"].alias("distance_m"), b.alias("bearing_deg"), c["height_m"].alias("height_m"), c["relation"].alias("relation"), cx.alias("gx"), (F.col("camera_y") + c["height_m"]).alias("gy"), cz.alias("gz"))

    return rows.withColumns({"gx": x, "gy": F.col("camera_y") + F.col("height_m"), "gz": z, context: F.transform(F.slice(F.col(context), 1, MAX_SURROUNDINGS), near)})


def normalised_detections(detections: DataFrame, wanted: list[str], keys: list[str], most: int = 24) -> DataFrame:
    """Detections whose canonical label is wanted, the surest first, ``most`` for each key (label, confidence, det_idx, bbox)."""
    label = canonical_label(F.col("label"), "")
    # one explode keeps the long expression from being copied into every use of the label
    good = detections.where(F.size("bbox") >= 4).withColumn("label", F.explode(F.array(label))).where((F.col("label") != "") & F.col("label").isin(wanted))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "label", "det_idx")
    return good.withColumn("bbox", F.slice("bbox", 1, 4)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, most))


def serialised_detection(label: Column, confidence: Column, box: Column, area: Column) -> Column:
    """A detection as canonical JSON; boxes in whole pixels."""
    return F.to_json(F.struct(label.cast("string").alias("label"), confidence.cast("double").alias("confidence"), F.transform(box, lambda v: v.cast("int")).alias("bbox_xyxy"), area.cast("double").alias("area_ratio")))


def mask_centroids(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean place of the pixels in each mask (px, py, in_mask); masks without a pixel are not there."""
    return pixels.where("in_mask").groupBy(*keys).agg(F.avg("px").alias("cx"), F.avg("py").alias("cy"), F.count(F.lit(1)).alias("area_px"))


def of_entries(rows: DataFrame, entry_ids: list[int] | None, column: str = "entry_id") -> DataFrame:
    """Rows of the entries; none named is no filter."""
    return rows.where(F.col(column).isin(*entry_ids)) if entry_ids else rows


def listed_ids(value: str | None, number: bool = True) -> list:
    """Identifiers of a list with commas, in order; words count once, numbers as often as named."""
    parts = [p.strip() for p in (value or "").split(",") if p.strip()]
    return [int(p) for p in parts] if number else list(dict.fromkeys(parts))


def wrapped(text: Column, most: int) -> Column:
    """Lines of whole words of at most ``most`` characters where words allow it."""
    step = lambda acc, w: F.when(
        (F.element_at(acc, -1) != "") & (F.length(F.element_at(acc, -1)) + 1 + F.length(w) > most), F.concat(acc, F.array(w))
    ).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.when(F.element_at(acc, -1) == "", w).otherwise(F.concat_ws(" ", F.element_at(acc, -1), w)))))
    return F.aggregate(F.filter(F.split(F.trim(text), "\\s+"), lambda w: w != ""), F.array(F.lit("")), step)


def query_texts(short: Column, long: Column, hint: Column, source: Column) -> Column:
    """Struct of short, long and source: what a description gives, else the detector's label."""
    known = lambda c: F.when(~F.lower(safe_or(c, "")).isin("", "unknown"), safe_text(c, ""))
    s, l, label = known(short), known(long), safe_or(hint, "unknown")  # noqa: E741
    return F.struct(
        F.coalesce(s, l, label).alias("short"), F.coalesce(l, s, label).alias("long"),
        F.when(s.isNotNull() | l.isNotNull(), F.coalesce(source, F.lit("unknown"))).otherwise("fallback_label").alias("source"),
    )


def text_of_mode(texts: Column, mode: str) -> Column:
    long = F.when(~F.lower(safe_or(texts["long"], "")).isin("", "unknown"), texts["long"])
    short = F.when(safe_or(texts["short"], "") != "", texts["short"])
    return F.coalesce(long, short, F.lit("unknown")) if mode.strip().lower() == "long" else F.coalesce(short, long, F.lit("unknown"))


def valid_box(box: Column) -> Column:
    """A box (x, y, w, h) within [0, 1]; null if it has fewer than four numbers or no extent."""
    side = lambda i: F.get(box, F.lit(i)).cast("double")
    whole = (F.size(box) >= 4) & ~F.exists(F.slice(box, 1, 4), lambda v: v.isNull())
    return F.when(whole & (F.greatest(side(2), side(3)) > 1e-6), F.array(*(F.least(F.lit(1.0), F.greatest(F.lit(0.0), side(i))) for i in range(4))))


def fallback_anchors(objects: DataFrame, view: str, width: int, height: int) -> DataFrame:
    """Where objects without a box are marked: by side and height, those of one bucket next to each other."""
    side, level = F.lower(F.coalesce("laterality", F.lit("center"))), F.lower(F.coalesce("verticality", F.lit("middle")))
    share = lambda c, known: F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in known.items()), F.lit(0.50))
    rows = objects.withColumns({"_s": share(side, ANCHOR_X), "_l": share(level, ANCHOR_Y)})
    rank = F.row_number().over(Window.partitionBy(view, "_s", "_l").orderBy("object_global_id")) - 1
    put = lambda v, most: F.least(F.greatest(v, F.lit(16)), F.lit(max(16, most - 16))).cast("int")
    rows = rows.withColumn("_r", rank)
    x = put(F.bround(width * F.col("_s"), 0) + F.floor(F.col("_r") / 3) * 42, width)
    y = put(F.bround(height * F.col("_l"), 0) + F.col("_r") % 3 * 26, height)
    return rows.withColumns({"anchor_x": x, "anchor_y": y}).drop("_s", "_l", "_r")


def selector_attributes(payload: Column) -> Column:
    """A selector's answer (a struct or null) as view attributes with defaults."""
    kinds = ("view_type", "room_function", "style_hint", "clutter_level", "floor_pattern", "lighting_ceiling", "wall_color")
    text = lambda n, d: F.coalesce(F.when(payload[n] != "", payload[n]), F.lit(d)).alias(n)
    listed = F.filter(F.transform(F.coalesce(payload["scene_attributes"], F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    return F.struct(*(text(k, "unknown") for k in kinds), listed.alias("scene_attributes"), text("additional_notes", ""), text("image_summary", ""))


def report_counts(views: DataFrame, objects: DataFrame) -> DataFrame:
    """A build report's counters: views by parse status, objects by side, and the mean number of objects."""
    status = F.coalesce("parse_status", F.lit(""))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    v = views.agg(count(status == "ok").alias("parse_ok"), count(status == "fallback").alias("parse_fallback"), count(~status.isin("ok", "fallback")).alias("parse_failed"), F.count(F.lit(1)).alias("total_entries"))
    o = objects.agg(*(count(F.col("angle_bucket") == b).alias(f"{b}_objects") for b in ("left", "center", "right")), F.count(F.lit(1)).alias("total_objects"))
    mean = F.when(F.col("total_entries") > 0, F.col("total_objects") / F.col("total_entries")).otherwise(0.0)
    return v.crossJoin(o).withColumn("avg_objects_per_frame", mean)  # one row each
