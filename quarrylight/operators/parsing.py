"""Scene documents: from lenient JSON to normalised scenes and one row per object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import canonical_label
from ..functions.texts import DISTANCE, LATERALITY, MAX_SURROUNDINGS, VERTICALITY, enum_value, rank_of, safe_or

# The closed sets of a scene document.
VIEW_TYPES = ("living room", "bedroom", "kitchen", "bathroom", "dining room", "hallway", "entryway", "balcony", "laundry room", "staircase", "study", "utility room", "unknown", "other")
ROOM_FUNCTIONS = ("resting", "cooking", "dining", "bathing", "working", "storage", "circulation", "mixed", "unknown")
STYLES = ("modern", "minimalist", "traditional", "rustic", "industrial", "scandinavian", "eclectic", "unknown", "other")
CLUTTER = ("low", "medium", "high", "unknown")
FLOORS = ("wood", "laminate", "tile", "carpet", "rug", "stone", "concrete", "unknown", "other")
LIGHTING = ("recessed lights", "chandelier", "pendant lights", "ceiling lamp", "ceiling fan light", "natural light source", "mixed lighting", "unknown", "other")
SUPPORT = ("on", "under", "inside", "hanging_on", "attached_to", "freestanding", "unknown")
SUPPORT_NAMES = {"hanging on": "hanging_on", "attached to": "attached_to"}
BACKGROUND = ("wall feature", "floor pattern")
# A JSON object with any of these keys is a scene document.
SIGNATURE = ("visual_feature", "visual_features", "view_type", "room_function", "style_hint", "clutter_level", "image_summary", "objects")

_FEATURE = "struct<feature_id:string,type:string,description:string,attributes:array<string>,relative_position_laterality:string,laterality:string,relative_position_distance:string,distance:string,relative_position_verticality:string,verticality:string,distance_from_camera_m:string,relative_height_from_camera_m:string,relative_bearing_deg:string,estimated_global_x:string,estimated_global_y:string,estimated_global_z:string,support_relation:string,any_text:string,long_form_open_description:string,`Long form open description`:string,location_relative_to_other_objects:string,surrounding_context:variant>"
_OLD = "struct<meta:struct<label:string,attributes:array<string>>,location:struct<bbox_xywh_norm:array<double>>>"
_SCENE = "struct<view_type:string,room_function:string,style_hint:string,clutter_level:string,floor_pattern:string,lighting_ceiling:string,wall_color:string,`wall color`:string,additional_notes:string,image_summary:string,scene_attributes:array<string>,visual_feature:variant,visual_features:variant,objects:variant>"


def _is_object(item: Column) -> Column:
    return F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False))


def _items(value: Column) -> Column:
    """The items of a variant that is an array; no items if it is anything else."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def _structs(value: Column, schema: str) -> Column:
    """The objects among the items, each read on its own, so that a strange one does not spoil the others."""
    return F.transform(F.filter(_items(value), _is_object), lambda f: F.from_json(F.to_json(f), schema))


def json_object(text: Column) -> Column:
    """The text if it is a JSON object, else what stands from its first brace to its last, if that is one; else null."""
    is_object = lambda t: F.coalesce(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.lit(False))
    inner = F.regexp_extract(text, "(?s)\\{.*\\}", 0)
    return F.when(is_object(F.trim(text)), F.trim(text)).when((inner != "") & is_object(inner), inner)


def clean_list(items: Column) -> Column:
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")


def number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def bins_from_bbox(box: Column) -> tuple[Column, Column, Column]:
    """Laterality, distance and verticality of a box (x, y, w, h) in shares of the image."""
    cut = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x, y, w, h = (F.coalesce(F.get(box, F.lit(i)), F.lit(0.0)) for i in range(4))
    cx, cy, area = cut(x + w / 2), cut(y + h / 2), cut(w) * cut(h)
    third = lambda v, a, b, c: F.when(v < 0.34, a).when(v < 0.67, b).otherwise(c)
    return third(cx, "left", "center", "right"), F.when(area >= 0.18, "near").when(area >= 0.06, "middle").otherwise("far"), third(cy, "high", "middle", "low")


def bins_from_geometry(cx: Column, cy: Column, width: Column, height: Column, distance: Column) -> tuple[Column, Column, Column]:
    third = lambda v, a, b, c: F.when(v < 0.34, a).when(v < 0.67, b).otherwise(c)
    return third(cx / width, "left", "center", "right"), F.when(distance < 1.5, "near").when(distance < 4.0, "middle").otherwise("far"), third(cy / height, "high", "middle", "low")


def _surroundings(raw: Column) -> Column:
    """The first surroundings listed, whatever they are, and of those the objects."""
    numbers = ("distance_from_primary_m", "distance_from_camera_m", "relative_height_from_camera_m", "relative_bearing_deg", "estimated_global_x", "estimated_global_y", "estimated_global_z")
    text = lambda c, n: F.try_variant_get(c, f"$.{n}", "string")
    one = lambda c: F.struct(safe_or(text(c, "label"), "unknown").alias("label"), clean_list(F.try_variant_get(c, "$.attributes", "array<string>")).alias("attributes"), *(number(text(c, n)).alias(n) for n in numbers), safe_or(text(c, "relation_to_primary"), "").alias("relation_to_primary"))
    return F.transform(F.filter(F.slice(_items(raw), 1, MAX_SURROUNDINGS), _is_object), one)


def _feature(f: Column, i: Column) -> Column:
    choice = lambda *names: F.coalesce(*(f[n] for n in names))
    numbers = ("distance_from_camera_m", "relative_height_from_camera_m", "relative_bearing_deg", "estimated_global_x", "estimated_global_y", "estimated_global_z")
    return F.struct(
        safe_or(f["feature_id"], "").alias("given_id"), i.alias("position"), f["type"].alias("raw_type"), canonical_label(f["type"]).alias("type"),
        safe_or(f["description"], "unknown").alias("description"), clean_list(f["attributes"]).alias("attributes"),
        enum_value(choice("relative_position_laterality", "laterality"), LATERALITY, "center").alias("laterality"),
        enum_value(choice("relative_position_distance", "distance"), DISTANCE, "middle").alias("distance"),
        enum_value(choice("relative_position_verticality", "verticality"), VERTICALITY, "middle").alias("verticality"),
        *(number(f[n]).alias(n) for n in numbers),
        enum_value(f["support_relation"], SUPPORT, "unknown", SUPPORT_NAMES).alias("support_relation"), safe_or(f["any_text"], "").alias("any_text"),
        safe_or(choice("long_form_open_description", "Long form open description"), "").alias("long_form"), _surroundings(f["surrounding_context"]).alias("surroundings"),
    )


def _old_feature(o: Column, i: Column) -> Column:
    side, distance, height = bins_from_bbox(o["location"]["bbox_xywh_norm"])
    label, attributes = safe_or(o["meta"]["label"], "unknown"), clean_list(o["meta"]["attributes"])
    text = F.when(F.size(attributes) > 0, F.concat(label, F.lit(" ("), F.array_join(F.slice(attributes, 1, 4), ", "), F.lit(")"))).otherwise(label)
    missing = F.lit(None).cast("double")
    return F.struct(
        F.lit("").alias("given_id"), i.alias("position"), label.alias("raw_type"), canonical_label(label).alias("type"), text.alias("description"), attributes.alias("attributes"),
        side.alias("laterality"), distance.alias("distance"), height.alias("verticality"),
        *(missing.alias(n) for n in ("distance_from_camera_m", "relative_height_from_camera_m", "relative_bearing_deg", "estimated_global_x", "estimated_global_y", "estimated_global_z")),
        F.lit("unknown").alias("support_relation"), F.lit("").alias("any_text"), text.alias("long_form"), _surroundings(F.lit(None).cast("variant")).alias("surroundings"),
    )


def parse_scenes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``status`` (ok, legacy, failed) and the normalised scene to rows with a JSON text; other columns stay.

    Values outside a closed set get its default, never an error. Background features move to the scene's attributes.
    """
    rows = docs.withColumn("_json", json_object(F.col(text))).withColumn("_s", F.from_json("_json", _SCENE))
    keys = F.json_object_keys("_json")
    signed = F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, SIGNATURE))), F.lit(False))
    is_old = F.array_contains(keys, "objects") & ~F.array_contains(keys, "visual_feature") & ~F.array_contains(keys, "visual_features")
    rows = rows.withColumn("status", F.when(~signed, "failed").when(is_old, "legacy").otherwise("ok"))
    s = F.col("_s")
    new = F.transform(_structs(F.coalesce(s["visual_feature"], s["visual_features"]), _FEATURE), _feature)
    old = F.transform(_structs(s["objects"], _OLD), _old_feature)
    rows = rows.withColumn("_all", F.when(F.col("status") == "legacy", old).otherwise(new))
    background = lambda f: F.translate(F.lower(F.trim(F.coalesce(f["raw_type"], F.lit("")))), "_-", "  ").isin(*BACKGROUND)
    parts = lambda f: F.slice(F.filter(F.array(F.when(f["description"] != "unknown", f["description"]), F.when(F.size(f["attributes"]) > 0, F.array_join(F.slice(f["attributes"], 1, 4), ", ")), F.when(~f["long_form"].isin("", "unknown"), f["long_form"])), lambda p: p.isNotNull()), 1, 2)
    moved = F.transform(F.filter("_all", lambda f: background(f) & (F.size(parts(f)) > 0)), lambda f: F.concat(F.when(F.lower(f["raw_type"]).startswith("wall"), "wall detail: ").otherwise("floor detail: "), F.array_join(parts(f), " | ")))
    scene = {"view_type": VIEW_TYPES, "room_function": ROOM_FUNCTIONS, "style_hint": STYLES, "clutter_level": CLUTTER, "floor_pattern": FLOORS, "lighting_ceiling": LIGHTING}
    return rows.withColumns({
        **{k: enum_value(s[k], allowed, "unknown") for k, allowed in scene.items()},
        "wall_color": safe_or(F.coalesce(s["wall_color"], s["wall color"]), "unknown"), "image_summary": safe_or(s["image_summary"], ""), "additional_notes": safe_or(s["additional_notes"], ""),
        "scene_attributes": F.concat(clean_list(s["scene_attributes"]), moved), "features": F.filter("_all", lambda f: ~background(f)),
    }).drop("_json", "_s", "_all")


def explode_features(scenes: DataFrame, key: str, limit: int = 24) -> DataFrame:
    """One row per object, in the order left to right, near to far, high to low; ``limit`` at most, if it is above 0."""
    f = F.col("f")
    rows = scenes.select(key, F.explode("features").alias("f")).select(
        key, F.when(f["given_id"] != "", f["given_id"]).otherwise(F.format_string("feat_%03d", f["position"])).alias("feature_id"),
        *(f[c].alias(c) for c in ("type", "description", "attributes", "laterality", "distance", "verticality", "distance_from_camera_m", "relative_bearing_deg", "estimated_global_x", "estimated_global_z", "support_relation", "surroundings")),
    )
    from pyspark.sql.window import Window

    order = Window.partitionBy(key).orderBy(rank_of(F.col("laterality"), LATERALITY), rank_of(F.col("distance"), DISTANCE), rank_of(F.col("verticality"), VERTICALITY), "type", "feature_id")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= limit) if limit > 0 else rows
