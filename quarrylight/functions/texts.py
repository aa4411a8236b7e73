"""Text rules: cleaning, tokens, composed descriptions, rounding formatters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import taxonomy  # noqa: F401  the label rules belong to the text rules

#: Texts that say nothing.
EMPTY_TEXTS = ("", "unknown", "none", "null", "n/a", "na")
#: At most so many surroundings are kept for an object.
MAX_SURROUNDINGS = 5


def safe_text(value: Column, default: str = "") -> Column:
    """White space collapsed; ``default`` for nothing."""
    flat = F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "\\s+", " "))
    return F.when(flat == "", default).otherwise(flat)


def usable(text: Column) -> Column:
    return ~F.lower(safe_text(text)).isin(*EMPTY_TEXTS)


def first_usable(*texts: Column) -> Column:
    return F.coalesce(*(F.when(usable(t), safe_text(t)) for t in texts))


def sanitised(value: Column, limit: int = 180) -> Column:
    """Field separators replaced; longer texts are cut and end in "..."."""
    flat = F.translate(F.trim(F.coalesce(value.cast("string"), F.lit(""))), "\n;|", " ,/")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def fragment(value: Column) -> Column:
    """Safe inside a neighbour list."""
    return F.translate(safe_text(value), "|;[]", "/,()")


def slug(value: Column) -> Column:
    cut = F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9._-]+", "_")
    return F.regexp_replace(cut, "^_+|_+$", "")


def tokens(*values: Column) -> Column:
    """Distinct runs of a-z and 0-9 of at least three characters."""
    joined = F.lower(F.concat_ws(" ", *(safe_text(v) for v in values)))
    return F.array_distinct(F.filter(F.regexp_extract_all(joined, F.lit("([a-z0-9]+)")), lambda t: F.length(t) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def words_for_ranking(text: Column) -> Column:
    return F.split(F.lower(F.trim(text)), "\\s+")


def enum_value(value: Column, allowed: tuple[str, ...], default: str, aliases: dict[str, str] | None = None) -> Column:
    """A member of a closed set, or the default; underscores and hyphens count as spaces."""
    token = F.translate(F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))), "_-", "  ")
    if aliases:
        token = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), token), token)
    return F.when(token.isin(*allowed), token).otherwise(default)


def half_metre(value: Column) -> Column:
    """On a grid of half a metre, ties to even; "na" for nothing."""
    return F.when(value.isNull(), "na").otherwise(F.format_string("%.1f", F.bround(value * 2, 0) / 2))


def tenth(value: Column) -> Column:
    return F.when(value.isNull(), "na").otherwise(F.format_string("%.1f", F.bround(value, 1)))


def clean_items(items: Column, limit: int) -> Column:
    """First distinct items that are neither blank nor unknown."""
    trimmed = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda x: ~F.lower(x).isin("", "unknown"))), 1, limit)


def top_surroundings(context: Column, limit: int) -> Column:
    """Labelled surroundings by distance (missing last), then label."""
    named = F.filter(context, lambda c: F.trim(F.coalesce(c["label"], F.lit(""))) != "")
    keyed = F.transform(named, lambda c, i: F.struct(c["distance_from_primary_m"].isNull().alias("missing"), F.coalesce(c["distance_from_primary_m"], F.lit(0.0)).alias("d"), c["label"].alias("label"), i.alias("i"), c.alias("c")))
    return F.slice(F.transform(F.array_sort(keyed), lambda k: k["c"]), 1, limit)


def anchor(x: Column, z: Column) -> Column:
    return F.concat(F.lit("x="), half_metre(x), F.lit(", z="), half_metre(z))


def nearby_list(context: Column, limit: int = 2) -> Column:
    shown = F.transform(top_surroundings(context, limit), lambda c: F.concat(c["label"], F.lit("@("), half_metre(c["estimated_global_x"]), F.lit(","), half_metre(c["estimated_global_z"]), F.lit(")")))
    return F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise("none")


def long_surroundings(context: Column, limit: int = MAX_SURROUNDINGS) -> Column:
    shown = F.transform(top_surroundings(context, limit), lambda c: F.concat(
        c["label"], F.lit(" | relation="), safe_or(c["relation_to_primary"], "unknown"), F.lit(" | primary_dist="), tenth(c["distance_from_primary_m"]),
        F.lit(" | global=("), half_metre(c["estimated_global_x"]), F.lit(","), half_metre(c["estimated_global_z"]), F.lit(")"),
    ))
    return F.when(F.size(shown) > 0, F.array_join(shown, "; ")).otherwise("none")


def safe_or(value: Column, default: str) -> Column:
    cut = F.trim(F.coalesce(value, F.lit("")))
    return F.when(cut == "", default).otherwise(cut)


def joined_or_none(items: Column, sep: str = ", ") -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, sep)).otherwise("none")


def short_object_text(label: Column, attributes: Column, x: Column, z: Column, context: Column) -> Column:
    return safe_text(F.concat(
        F.lit("object: "), label, F.lit(" | attrs: "), joined_or_none(clean_items(attributes, 4)),
        F.lit(" | anchor: "), anchor(x, z), F.lit(" | nearby: "), nearby_list(context),
    ))


def scene_context_text(floor: Column, attributes: Column, wall: Column) -> Column:
    return F.concat(F.lit("floor_pattern="), F.coalesce(floor, F.lit("unknown")), F.lit("; scene_attributes="), joined_or_none(clean_items(attributes, 6)), F.lit("; wall_color="), safe_or(wall, "unknown"))


def long_object_text(label: Column, attributes: Column, distance: Column, bearing: Column, laterality: Column, verticality: Column, x: Column, z: Column, context: Column, scene: Column) -> Column:
    return safe_text(F.concat(
        F.lit("object: "), label, F.lit(" | attributes: "), joined_or_none(clean_items(attributes, 6)),
        F.lit(" | camera_relation: distance="), tenth(distance), F.lit(", bearing="), tenth(bearing),
        F.lit(", laterality="), laterality, F.lit(", verticality="), verticality,
        F.lit(" | global_anchor: "), anchor(x, z), F.lit(" | surroundings: "), long_surroundings(context), F.lit(" | scene_context: "), scene,
    ))


def neighbour_text(context: Column, limit: int = MAX_SURROUNDINGS) -> Column:
    """``label [relation, 0.6m]; ...`` for embedding, or ``none``."""
    shown = F.transform(top_surroundings(context, limit), lambda c: F.concat(
        fragment(c["label"]), F.lit(" ["), F.concat_ws(", ", F.when(fragment(c["relation_to_primary"]) != "", fragment(c["relation_to_primary"])), F.format_string("%.1fm", c["distance_from_primary_m"])), F.lit("]"),
    ))
    return joined_or_none(shown, "; ")


def location_summary(neighbours: Column) -> Column:
    """Polar form: ``label@1.20m[relation|NE]``, joined by " ; "."""
    return F.array_join(F.transform(neighbours, lambda n: F.concat(
        safe_text(n["label"], "unknown"), F.lit("@"), F.format_string("%.2f", F.coalesce(n["distance_from_primary_m"], F.lit(0.0))), F.lit("m["),
        safe_or(n["semantic_relation_local"], "nearby"), F.when(safe_or(n["allocentric_direction_8"], "") != "", F.concat(F.lit("|"), n["allocentric_direction_8"])).otherwise(""), F.lit("]"),
    )), " ; ")


def builder_location_summary(context: Column) -> Column:
    """Builder form: ``label relation=... d=0.8m anchor=(1.0,-2.5)``, joined by " ; "."""
    return F.array_join(F.transform(context, lambda c: F.concat(
        c["label"], F.lit(" relation="), safe_or(c["relation_to_primary"], "unknown"), F.lit(" d="), tenth(c["distance_from_primary_m"]),
        F.when(c["distance_from_primary_m"].isNotNull(), "m").otherwise(""), F.lit(" anchor=("), half_metre(c["estimated_global_x"]), F.lit(","), half_metre(c["estimated_global_z"]), F.lit(")"),
    )), " ; ")


def content_key(*parts: Column) -> Column:
    """Key of a cached answer: MD5 over the parts."""
    return F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """Position in an enum, 9 for anything else."""
    out = F.lit(9)
    for i, name in reversed(list(enumerate(order))):
        out = F.when(value == name, i).otherwise(out)
    return out


LATERALITY, DISTANCE, VERTICALITY = ("left", "center", "right"), ("near", "middle", "far"), ("high", "middle", "low")


def canonical_line(feature_id: Column, kind: Column, laterality: Column, distance_bin: Column, verticality: Column, support: Column, distance: Column, bearing: Column, x: Column, z: Column, attributes: Column, context: Column, seen_text: Column, description: Column) -> Column:
    """One object as ``key=value`` fields joined by semicolons, in a fixed order."""
    number = lambda v, form: F.when(v.isNull(), "na").otherwise(F.format_string(form, v))
    near = F.transform(top_surroundings(context, MAX_SURROUNDINGS), lambda c: F.concat(
        sanitised(c["label"], 40), F.lit("@"), half_metre(c["estimated_global_x"]), F.lit(","), half_metre(c["estimated_global_z"]), F.lit("~"), tenth(c["distance_from_primary_m"]), F.lit("#"), sanitised(safe_or(c["relation_to_primary"], "unknown"), 40),
    ))
    listed = F.transform(clean_items(attributes, 6), lambda a: sanitised(a, 40))
    fields = {
        "feature": feature_id, "type": kind, "lat": laterality, "dist": distance_bin, "vert": verticality, "support": support, "dcam": number(distance, "%.2f"), "bearing": number(bearing, "%.1f"),
        "gx": half_metre(x), "gz": half_metre(z), "attrs": joined_or_none(listed, ","), "ctx": joined_or_none(near, ","), "text": sanitised(seen_text, 120), "desc": sanitised(description, 220),
    }
    return F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v) for k, v in fields.items()))


def scene_prefix(scene: Column) -> Column:
    """The scene's own fields, before its objects' lines."""
    fields = {
        "view_type": scene["view_type"], "room_function": scene["room_function"], "style_hint": scene["style_hint"], "clutter_level": scene["clutter_level"], "floor_pattern": scene["floor_pattern"], "lighting": scene["lighting_ceiling"],
        "scene_attributes": sanitised(joined_or_none(clean_items(scene["scene_attributes"], 8)), 120), "wall_color": sanitised(scene["wall_color"], 80), "notes": sanitised(scene["additional_notes"], 160), "summary": sanitised(scene["image_summary"], 220),
    }
    return F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.coalesce(v, F.lit(""))) for k, v in fields.items()))
