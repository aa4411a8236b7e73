"""The engine's queries on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import angles, taxonomy, texts
from ..functions.vectors import dot, l2_normalised
from ..operators import clustering, components, detections, graph, hybrid, incremental, metrics, mining, parsing, products, records, relations, rooms, search, similarity, upkeep
from ..sources.scenes import OBS_SQL, derived_observations, derived_views
from . import scene

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WITH = f"WITH {OBS_SQL}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(column: str, places: int = 6) -> F.Column:
    return F.round(F.col(column), places).alias(column)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth object asks for its like."""
    o = derived_observations(spark, d).where("object_global_id % 50 = 0")
    return o.select(F.col("object_global_id").alias("query_id"), F.col("vec").alias("query_vec"))


ASKED = "asked AS (SELECT object_global_id AS query_id, vec AS query_vec FROM obs WHERE object_global_id % 50 = 0)"
HITS = f"{ASKED}, hits AS (SELECT query_id, object_global_id, entry_id, list_inner_product(query_vec, vec) AS score FROM obs, asked)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return derived_observations(spark, d).select("object_global_id", "entry_id", "vec")


@query(f"{WITH}, {HITS} SELECT query_id, object_global_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, object_global_id) AS rank FROM hits) WHERE rank <= 5")
def vector_topk(spark, d):
    hits = products.nearest_rows(_asked(spark, d), _rows(spark, d), "object_global_id", 5, 9)
    return search.top(hits, ["query_id"], [F.desc(F.round("score", 9)), F.asc("object_global_id")], 5).select("query_id", "object_global_id", _r("score"), "rank")


@query(f"{WITH}, {HITS} SELECT query_id, object_global_id, round(f, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, object_global_id) AS rank FROM (SELECT *, round(score * 0.3 + (1 - abs(query_id - object_global_id) / 1000::DOUBLE) * 0.7, 9) AS f FROM hits)) WHERE rank <= 5")
def vector_fused_topk(spark, d):
    hits = products.nearest_rows(_asked(spark, d), _rows(spark, d), "object_global_id", 5, 9, weight=0.3, more=lambda q, o: (1 - abs(q - o) / 1000) * 0.7).withColumn("score", F.round("score", 9))
    return search.top(hits, ["query_id"], [F.desc("score"), F.asc("object_global_id")], 5).select("query_id", "object_global_id", _r("score"), "rank")


@query(f"{WITH}, {HITS} SELECT query_id, entry_id, round(greatest(max(score), 0), 6) AS score FROM hits GROUP BY ALL")
def entry_max_score(spark, d):
    return search.entry_scores(_asked(spark, d), _rows(spark, d), "object_global_id").select("query_id", "entry_id", _r("score"))


@query(f"{WITH}, {HITS} SELECT query_id, entry_id, object_global_id, score FROM (SELECT query_id, entry_id, object_global_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id, entry_id ORDER BY round(score, 9) DESC, object_global_id) AS k FROM hits WHERE score > -1) WHERE k = 1")
def entry_best_match(spark, d):
    return search.best_match(_asked(spark, d), _rows(spark, d), "object_global_id", 9).select("query_id", "entry_id", "object_global_id", _r("score"))


RANKED = """, e AS (SELECT query_id, entry_id, round(greatest(max(score), 0), 9) AS score FROM hits GROUP BY ALL),
p AS (SELECT e.*, x, z, orientation, row_number() OVER (PARTITION BY query_id, round_even(x, 3), round_even(z, 3) ORDER BY score DESC, entry_id) AS k FROM e JOIN views ON views.id = entry_id)
SELECT query_id, entry_id, round(score, 6) AS score, x, z, orientation, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM p WHERE k = 1) WHERE rank <= 5"""


@query(f"{WITH}, {HITS}{RANKED}")
def rank_position_dedup(spark, d):
    """The flagship: for each query object the five best views, one per position."""
    best = search.best_entries(_asked(spark, d), _rows(spark, d), derived_views(spark, d), 10, 9)
    return best.select("query_id", "entry_id", _r("score"), "x", "z", "orientation", "rank")


@query(f"{WITH}, {HITS} SELECT entry_id, round(avg(best), 6) AS score FROM (SELECT query_id, entry_id, max(score) AS best FROM hits GROUP BY ALL) GROUP BY entry_id")
def frame_maxsim(spark, d):
    o = _rows(spark, d)
    return search.max_similarity(_asked(spark, d), o, o.select("entry_id")).select("entry_id", _r("score"))


@query(f"{WITH}, {HITS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_global_id) AS k FROM hits) WHERE k <= 64), b AS (SELECT query_id, entry_id, greatest(max(score), 0) AS best FROM t GROUP BY ALL) SELECT v.id AS entry_id, round(coalesce(sum(best), 0) / (SELECT count(*) FROM asked), 6) AS score FROM views v LEFT JOIN b ON b.entry_id = v.id GROUP BY v.id")
def frame_maxsim_pool(spark, d):
    o = _rows(spark, d)
    return search.pooled_similarity(_asked(spark, d), o, o.select("entry_id"), "object_global_id", 64).select("entry_id", _r("score"))


BM25 = """, q(query_id, text) AS (VALUES (1, 'door of kind 3'), (2, 'plant seen in mirror'), (3, 'clock stairs')),
w AS (SELECT object_global_id AS id, unnest(string_split(description, ' ')) AS term FROM obs), tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT id, count(*) AS length FROM w GROUP BY id), c AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
raw AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tf, c GROUP BY term, n), m AS (SELECT avg(raw) AS mraw FROM raw),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * mraw ELSE raw END AS idf FROM raw, m),
a AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(string_split(text, ' ')) AS term FROM q) GROUP BY ALL),
bm AS (SELECT query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS bm25 FROM a JOIN idf USING (term) JOIN tf USING (term) JOIN l USING (id), c GROUP BY ALL)"""


def _bm25(spark, d):
    docs = derived_observations(spark, d).select(F.col("object_global_id").alias("id"), F.col("description").alias("text"))
    asked = spark.createDataFrame([(1, "door of kind 3"), (2, "plant seen in mirror"), (3, "clock stairs")], "query_id int, text string")
    return hybrid.bm25(docs, asked)


@query(f"{WITH}{BM25} SELECT query_id, id, round(bm25, 6) AS bm25 FROM bm")
def bm25_scores(spark, d):
    return _bm25(spark, d).select("query_id", "id", _r("bm25"))


@query(f"""{WITH}{BM25}, dn AS (SELECT query_id, o.object_global_id AS id, list_inner_product(o.vec, s.vec) AS score, 0.5 + (o.object_global_id % 5) / 10::DOUBLE AS confidence FROM obs o, q JOIN obs s ON s.object_global_id = query_id),
k AS (SELECT query_id, id, CASE WHEN p > 0 THEN bm25 / p ELSE bm25 END AS keyword FROM (SELECT *, max(bm25) OVER (PARTITION BY query_id) AS p FROM bm)),
h AS (SELECT query_id, id, round(0.55 * score + 0.15 * confidence + 0.30 * coalesce(keyword, 0), 6) AS combined FROM dn LEFT JOIN k USING (query_id, id) WHERE 0.55 * score + 0.15 * confidence + 0.30 * coalesce(keyword, 0) >= 0.25)
SELECT id, arg_max(query_id, (combined, -query_id)) AS query_id, max(combined) AS combined FROM h GROUP BY id""")
def hybrid_retrieve(spark, d):
    o = derived_observations(spark, d).select(F.col("object_global_id").alias("id"), "vec", (0.5 + (F.col("object_global_id") % 5) / 10).alias("confidence"))
    asked = derived_observations(spark, d).where("object_global_id in (1, 2, 3)").select(F.col("object_global_id").cast("int").alias("query_id"), F.col("vec").alias("query_vec"))
    scored = hybrid.hybrid(search.scores(asked, o), _bm25(spark, d)).select("query_id", "id", _r("combined"))
    return hybrid.best_of_queries(scored, ["id"]).select("id", "query_id", "combined")


@query(f"{WITH} SELECT object_global_id, round(list_sum(list_transform(list_transform(vec, lambda x: x * 3 / greatest(sqrt(list_inner_product(vec, vec)) * 3, 1e-12)), lambda y: y * y)), 6) AS length2, round(vec[1] / sqrt(list_inner_product(vec, vec)), 6) AS first FROM obs")
def l2_normalize(spark, d):
    unit = derived_observations(spark, d).select("object_global_id", l2_normalised(F.transform("vec", lambda x: x * 3)).alias("u"))
    return unit.select("object_global_id", F.round(dot(F.col("u"), F.col("u")), 6).alias("length2"), F.round(F.col("u")[0], 6).alias("first"))


@query(f"""{WITH}, a AS (SELECT object_global_id, bearing_deg * 7 AS a, orientation::DOUBLE AS b, distance_m FROM obs)
SELECT object_global_id, abs(((a - b + 180) % 360 + 360) % 360 - 180) AS circular, CASE WHEN ((a - b + 180) % 360 + 360) % 360 - 180 = -180 THEN 180 ELSE ((a - b + 180) % 360 + 360) % 360 - 180 END AS wrapped,
  round(sqrt(greatest(0, distance_m * distance_m + 1 - 2 * distance_m * cos(radians(abs(a))))), 6) AS polar FROM a""")
def angle_functions(spark, d):
    o = derived_observations(spark, d).select("object_global_id", (F.col("bearing_deg") * 7).alias("a"), F.col("orientation").cast("double").alias("b"), "distance_m")
    return o.select("object_global_id", angles.circular_difference(F.col("a"), F.col("b")).alias("circular"), angles.wrapped_delta(F.col("a") - F.col("b")).alias("wrapped"), F.round(angles.polar_distance(F.col("distance_m"), F.lit(1.0), F.col("a")), 6).alias("polar"))


@query(f"{WITH} SELECT object_global_id, round(gx, 6) AS gx, round(gy, 6) AS gy, round(gz, 6) AS gz FROM obs")
def ray_projection(spark, d):
    o = derived_observations(spark, d)
    x, y, z = angles.project_xyz(F.col("x"), F.lit(0.0), F.col("z"), F.col("orientation"), F.col("distance_m"), F.col("bearing_deg"), F.col("height_m"))
    return o.select("object_global_id", F.round(x, 6).alias("gx"), F.round(F.when(x.isNotNull(), y), 6).alias("gy"), F.round(z, 6).alias("gz"))


@query(f"""{WITH}, p AS (SELECT object_global_id, (object_global_id * 13 % 640)::DOUBLE AS px, (object_global_id * 7 % 480)::DOUBLE AS py, distance_m FROM obs),
a AS (SELECT *, degrees(atan((px - 319.5) / (640 / (2 * tan(radians(90.0) / 2))))) AS bearing, degrees(atan((239.5 - py) / (640 / (2 * tan(radians(90.0) / 2))))) AS elevation FROM p)
SELECT object_global_id, round(bearing, 6) AS bearing, round(elevation, 6) AS elevation, round(distance_m / cos(radians(bearing)), 6) AS planar, round(distance_m * tan(radians(elevation)), 11) AS height FROM a""")
def pinhole_angles(spark, d):
    o = derived_observations(spark, d).select("object_global_id", (F.col("object_global_id") * 13 % 640).cast("double").alias("px"), (F.col("object_global_id") * 7 % 480).cast("double").alias("py"), "distance_m")
    b, e = angles.pinhole_angles(F.col("px"), F.col("py"), F.lit(640.0), F.lit(480.0), F.lit(90.0))
    o = o.withColumns({"bearing": b, "elevation": e})
    return o.select("object_global_id", _r("bearing"), _r("elevation"), F.round(angles.planar_distance(F.col("distance_m"), F.col("bearing")), 6).alias("planar"), F.round(angles.height_from_depth(F.col("distance_m"), F.col("elevation")), 11).alias("height"))


@query(f"""{WITH}, b AS (SELECT object_global_id, round((degrees(atan2(gx - x, -(gz - z))) + 360) % 360, 6) AS bearing, (((orientation - bearing_deg) % 360) + 360) % 360 AS fallback FROM obs)
SELECT object_global_id, bearing, fallback, ['N','NE','E','SE','S','SW','W','NW'][(floor((fallback % 360 + 22.5) / 45)::INT % 8) + 1] AS direction8 FROM b""")
def compass8(spark, d):
    o = derived_observations(spark, d)
    fallback = angles.camera_bearing(F.col("orientation"), F.col("bearing_deg"))
    return o.select("object_global_id", F.round(angles.bearing_between(F.col("x"), F.col("z"), F.col("gx"), F.col("gz")), 6).alias("bearing"), fallback.alias("fallback"), angles.compass8(fallback).alias("direction8"))


@query(f"""{WITH}, s AS (SELECT object_global_id, vec[1] AS text, exp(-(distance_m * distance_m) / 4) AS geo, CASE WHEN object_global_id % 3 <> 0 THEN exp(-(power(height_m, 2) + power(bearing_deg / 45, 2))) END AS polar FROM obs)
SELECT object_global_id, round((0.7 * text + coalesce(0.2 * geo, 0) + coalesce(0.1 * polar, 0)) / (0.7 + CASE WHEN geo IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN polar IS NULL THEN 0 ELSE 0.1::DOUBLE END), 6) AS affinity FROM s""")
def gaussian_fusion(spark, d):
    o = derived_observations(spark, d)
    missing = F.lit(None).cast("double")
    polar = F.when(F.col("object_global_id") % 3 != 0, similarity.polar_similarity(missing, F.col("bearing_deg"), F.col("height_m")))
    return o.select("object_global_id", F.round(similarity.weighted_affinity([(F.col("vec")[0], 0.7), (angles.gaussian(F.col("distance_m"), 2.0), 0.2), (polar, 0.1)]), 6).alias("affinity"))


_TYPES_SQL = "[" + ",".join(f"'{t}'" for t in taxonomy.TYPES) + "]"
_ALIAS_SQL = "MAP {" + ",".join(f"'{a}': '{b}'" for a, b in taxonomy.ALIASES.items()) + "}"
#: How a detector may write an object's label.
RAW_LABEL = "CASE object_global_id % 8 WHEN 0 THEN upper(label) WHEN 1 THEN label || 's' WHEN 2 THEN replace(label, ' ', '_') WHEN 3 THEN '  ' || label || '-' WHEN 4 THEN ['Sofa', 'PLANTS', 'glasses', 'shelves', 'couches', 'dishes', 'TV stand', 'arm-chair'][{i}] WHEN 5 THEN label || 'es' WHEN 6 THEN '' ELSE 'no such ' || label END"


def _raw_label() -> F.Column:
    known = "'Sofa', 'PLANTS', 'glasses', 'shelves', 'couches', 'dishes', 'TV stand', 'arm-chair'"
    return F.expr(RAW_LABEL.replace(f"[{known}][{{i}}]", f"element_at(array({known}), cast((object_global_id div 8) % 8 + 1 as int))"))


@query(f"""{WITH}, v AS (SELECT object_global_id, {RAW_LABEL.replace("{i}", "object_global_id // 8 % 8 + 1")} AS raw FROM obs), t AS (SELECT *, replace(replace(lower(trim(raw)), '_', ' '), '-', ' ') AS t FROM v), n AS (SELECT *, coalesce({_ALIAS_SQL}[t], t) AS n FROM t)
SELECT object_global_id, raw, CASE WHEN t = '' THEN 'other' WHEN list_contains({_TYPES_SQL}, n) THEN n WHEN n LIKE '%s' AND list_contains({_TYPES_SQL}, n[:-2]) THEN n[:-2] WHEN n LIKE '%es' AND list_contains({_TYPES_SQL}, n[:-3]) THEN n[:-3] ELSE 'other' END AS label FROM n""")
def label_canonicalize(spark, d):
    raw = derived_observations(spark, d).select("object_global_id", _raw_label().alias("raw"))
    return raw.withColumn("label", taxonomy.canonical_label(F.col("raw")))


@query("""SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'unknown' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS safe,
CASE WHEN length(trim(text)) > 40 THEN translate(trim(text), chr(10) || ';|', ' ,/')[:37] || '...' ELSE translate(trim(text), chr(10) || ';|', ' ,/') END AS cut, md5(source || '|' || lang) AS key FROM documents""")
def text_normalize(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", texts.safe_text(F.col("text"), "unknown").alias("safe"), texts.sanitised(F.col("text"), 40).alias("cut"), texts.content_key(F.col("source"), F.col("lang")).alias("key"))


_HALF = "CASE WHEN {0} IS NULL THEN 'na' ELSE printf('%.1f', round_even({0} * 2, 0) / 2) END"
_TENTH = "CASE WHEN {0} IS NULL THEN 'na' ELSE printf('%.1f', round_even({0}, 1)) END"


@query(f"{WITH} SELECT object_global_id, {_HALF.format('(distance_m + 0.1)')} AS half, {_TENTH.format('height_m')} AS tenth FROM obs")
def round_formatters(spark, d):
    return derived_observations(spark, d).select("object_global_id", texts.half_metre(F.col("distance_m") + 0.1).alias("half"), texts.tenth(F.col("height_m")).alias("tenth"))


def _described(spark, d):
    """Objects with attributes and, as surroundings, the other objects of their view."""
    o = derived_observations(spark, d)
    i = F.col("object_global_id")
    o = o.withColumn("attributes", F.array(F.concat(F.lit("tone "), i % 5), F.lit("unknown"), F.concat(F.lit("size "), i % 3), F.concat(F.lit("tone "), i % 5)))
    other = o.select("entry_id", i.alias("other"), F.struct(F.col("label"), F.abs(F.col("height_m")).alias("distance_from_primary_m"), F.col("verticality").alias("relation_to_primary"), F.col("x").alias("estimated_global_x"), F.col("z").alias("estimated_global_z")).alias("c"))
    near = o.select("entry_id", i.alias("me")).join(other, "entry_id").where("me <> other").groupBy("me").agg(F.array_sort(F.collect_list("c")).alias("context"))
    return o.join(near, o["object_global_id"] == near["me"], "left")


OBJECT_TEXT = f"""{WITH}, n AS (SELECT a.object_global_id AS me, b.label, abs(b.height_m) AS dist, b.x, b.z, row_number() OVER (PARTITION BY a.object_global_id ORDER BY abs(b.height_m), b.label, b.verticality) AS k
  FROM obs a JOIN obs b ON a.entry_id = b.entry_id AND a.object_global_id <> b.object_global_id),
t AS (SELECT me, string_agg(label || '@(' || {_HALF.format('x')} || ',' || {_HALF.format('z')} || ')', ', ' ORDER BY k) AS nearby FROM n WHERE k <= 2 GROUP BY me),
s AS (SELECT object_global_id, entry_id, laterality, 'object: ' || label || ' | attrs: tone ' || object_global_id % 5 || ', size ' || object_global_id % 3 || ' | anchor: x=' || {_HALF.format('x')} || ', z=' || {_HALF.format('z')} || ' | nearby: ' || coalesce(nearby, 'none') AS text FROM obs LEFT JOIN t ON me = object_global_id)"""


def _short(spark, d):
    o = _described(spark, d)
    context = F.coalesce("context", F.expr("cast(array() as array<struct<label:string,distance_from_primary_m:double,relation_to_primary:string,estimated_global_x:double,estimated_global_z:double>>)"))
    return o.select("object_global_id", "entry_id", "laterality", texts.short_object_text(F.col("label"), F.col("attributes"), F.col("x"), F.col("z"), context).alias("text"))


@query(f"{OBJECT_TEXT} SELECT object_global_id, text FROM s")
def object_text_short(spark, d):
    return _short(spark, d).select("object_global_id", "text")


@query(f"{OBJECT_TEXT} SELECT entry_id, string_agg(text, ' | ' ORDER BY CASE laterality WHEN 'left' THEN 0 WHEN 'center' THEN 1 ELSE 2 END, object_global_id) AS text FROM s GROUP BY entry_id")
def frame_text(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct(texts.rank_of(F.col("laterality"), texts.LATERALITY).alias("r"), "object_global_id", "text")))
    return _short(spark, d).groupBy("entry_id").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " | ").alias("text"))


@query(f"""{WITH}, n AS (SELECT a.object_global_id AS me, b.label, abs(b.height_m) AS dist, b.verticality AS rel, row_number() OVER (PARTITION BY a.object_global_id ORDER BY abs(b.height_m), b.label, b.verticality) AS k
  FROM obs a JOIN obs b ON a.entry_id = b.entry_id AND a.object_global_id <> b.object_global_id)
SELECT me AS object_global_id, string_agg(label || ' [' || rel || ', ' || printf('%.1fm', dist) || ']', '; ' ORDER BY k) AS text FROM n WHERE k <= 5 GROUP BY me""")
def neighbor_text(spark, d):
    o = _described(spark, d).where("context is not null")
    return o.select("object_global_id", texts.neighbour_text(F.col("context")).alias("text"))


DIRECTION = """CASE WHEN sqrt(dx * dx + dz * dz) <= 0.25 THEN NULL
  WHEN abs(rt) >= abs(fw) THEN CASE WHEN rt > 0.25 THEN 'right' WHEN rt < -0.25 THEN 'left' END
  WHEN fw > 0.25 THEN 'in front' WHEN fw < -0.25 THEN 'behind' END"""
VERTICAL = "CASE WHEN dy > 0.25 THEN 'above' WHEN dy < -0.25 THEN 'below' WHEN dy IS NOT NULL THEN 'level' END"


@query(f"""{WITH}, r AS (SELECT view_id, object_global_id, gx - x AS dx, gy AS dy, gz - z AS dz, orientation FROM obs WHERE gx IS NOT NULL),
f AS (SELECT *, dx * cos(radians(orientation)) - dz * sin(radians(orientation)) AS rt, -dx * sin(radians(orientation)) - dz * cos(radians(orientation)) AS fw FROM r)
SELECT view_id, object_global_id, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz, round(sqrt(dx * dx + dz * dz), 6) AS distance_2d, round(sqrt(dx * dx + dz * dz + dy * dy), 6) AS distance_3d, {VERTICAL} AS vertical, {DIRECTION} AS direction FROM f""")
def view_object_relations(spark, d):
    r = relations.view_object(derived_views(spark, d), derived_observations(spark, d))
    return r.select("view_id", "object_global_id", *(_r(c) for c in ("dx", "dy", "dz", "distance_2d", "distance_3d")), "vertical", "direction")


@query(f"""{WITH}, r AS (SELECT a.entry_id, a.object_global_id AS source_id, b.object_global_id AS target_id, b.gx - a.gx AS dx, b.gy - a.gy AS dy, b.gz - a.gz AS dz, a.orientation FROM obs a JOIN obs b ON a.entry_id = b.entry_id AND a.object_global_id <> b.object_global_id WHERE a.gx IS NOT NULL AND b.gx IS NOT NULL),
f AS (SELECT *, dx * cos(radians(orientation)) - dz * sin(radians(orientation)) AS rt, -dx * sin(radians(orientation)) - dz * cos(radians(orientation)) AS fw FROM r)
SELECT * FROM (SELECT entry_id, source_id, target_id, {DIRECTION} AS direction, {VERTICAL} AS vertical, round(sqrt(dx * dx + dz * dz), 6) AS distance_2d, round(sqrt(dx * dx + dz * dz + dy * dy), 6) AS distance_3d FROM f) WHERE direction IS NOT NULL""")
def object_object_relations(spark, d):
    r = relations.object_object(derived_observations(spark, d))
    return r.select("entry_id", "source_id", "target_id", "direction", "vertical", _r("distance_2d"), _r("distance_3d"))


POLAR = f"""{WITH}, p AS (SELECT a.entry_id, a.object_global_id AS source_id, b.object_global_id AS target_id, b.label AS target_label, a.distance_m AS da, b.distance_m AS db,
  CASE WHEN ((b.bearing_deg - a.bearing_deg + 180) % 360 + 360) % 360 - 180 = -180 THEN 180 ELSE ((b.bearing_deg - a.bearing_deg + 180) % 360 + 360) % 360 - 180 END AS dt,
  b.distance_m - a.distance_m AS dd, b.height_m - a.height_m AS dh, b.gx - a.gx AS dx, b.gz - a.gz AS dz, a.orientation, b.bearing_deg AS bb
  FROM obs a JOIN obs b ON a.entry_id = b.entry_id AND a.object_global_id <> b.object_global_id WHERE a.distance_m IS NOT NULL AND b.distance_m IS NOT NULL),
k AS (SELECT *, sqrt(greatest(0, da * da + db * db - 2 * da * db * cos(radians(abs(dt))))) AS distance,
  CASE WHEN abs(dx) >= 1e-9 OR abs(dz) >= 1e-9 THEN (degrees(atan2(dx, -dz)) + 360) % 360 ELSE ((orientation - bb) % 360 + 360) % 360 END AS bearing FROM p),
rel AS (SELECT entry_id, source_id, target_id, target_label, distance, dt AS delta_angle_deg, dd AS delta_depth_m, dh AS delta_height_m,
  concat_ws(', ', CASE WHEN abs(dt) >= 5 THEN CASE WHEN abs(dt) < 20 THEN 'slightly ' ELSE '' END || CASE WHEN dt > 0 THEN 'right' ELSE 'left' END END,
    CASE WHEN abs(dd) >= 0.05 THEN CASE WHEN abs(dd) < 0.75 THEN 'slightly ' ELSE '' END || CASE WHEN dd > 0 THEN 'behind' ELSE 'in front' END END,
    CASE WHEN abs(dh) >= 0.25 THEN CASE WHEN dh > 0 THEN 'above' ELSE 'below' END END) AS phrase,
  bearing, ['N','NE','E','SE','S','SW','W','NW'][(floor((bearing + 22.5) / 45)::INT % 8) + 1] AS direction8 FROM k WHERE distance < 2)"""


@query(f"{POLAR} SELECT entry_id, source_id, target_id, target_label, round(distance, 6) AS distance, delta_angle_deg, round(delta_depth_m, 6) AS delta_depth_m, round(delta_height_m, 6) AS delta_height_m, phrase, round(bearing, 6) AS bearing, direction8 FROM rel")
def polar_relations(spark, d):
    r = relations.polar_relations(derived_observations(spark, d))
    return r.select("entry_id", "source_id", "target_id", "target_label", _r("distance"), "delta_angle_deg", _r("delta_depth_m"), _r("delta_height_m"), "phrase", _r("bearing"), "direction8")


@query(f"""{POLAR}, s AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY distance, target_id) AS k FROM rel)
SELECT o.object_global_id, count(s.k)::INT AS n, coalesce(string_agg(target_label || '@' || printf('%.2f', distance) || 'm[' || CASE WHEN phrase = '' THEN 'nearby' ELSE phrase END || '|' || direction8 || ']', ' ; ' ORDER BY k), '') AS summary
FROM obs o LEFT JOIN s ON s.source_id = o.object_global_id AND k <= 5 GROUP BY o.object_global_id""")
def polar_surroundings(spark, d):
    o = derived_observations(spark, d)
    return relations.polar_surroundings(o, relations.polar_relations(o)).select("object_global_id", "n", "summary")


# graph

PLACE_TABLE = """, spot AS (SELECT *, round_even(x, 4) AS kx, round_even(z, 4) AS kz FROM views),
mr AS (SELECT kx, kz, room_function, row_number() OVER (PARTITION BY kx, kz ORDER BY count(*) DESC, room_function) AS k FROM spot GROUP BY kx, kz, room_function),
mv AS (SELECT kx, kz, view_type, row_number() OVER (PARTITION BY kx, kz ORDER BY count(*) DESC, view_type) AS k FROM spot GROUP BY kx, kz, view_type),
g AS (SELECT kx, kz, min(id) AS first_view, arg_min(x, id) AS x, arg_min(z, id) AS z, count(*) AS n_views, list_sort(list(DISTINCT orientation)) AS scan_angles FROM spot GROUP BY kx, kz),
places AS (SELECT first_view, x, z, n_views, scan_angles, mr.room_function, mv.view_type, 'place_' || lpad((row_number() OVER (ORDER BY first_view) - 1)::VARCHAR, 5, '0') AS place_id, kx, kz
  FROM g JOIN mr USING (kx, kz) JOIN mv USING (kx, kz) WHERE mr.k = 1 AND mv.k = 1),
vp AS (SELECT spot.*, place_id FROM spot JOIN places USING (kx, kz)),
po AS (SELECT place_id, 'obs_' || lpad(object_global_id::VARCHAR, 6, '0') AS obs_id, object_global_id, label, view_id FROM obs),
nb AS (SELECT * FROM (SELECT a.place_id AS a, b.place_id AS b, b.x - a.x AS dx, b.z - a.z AS dz, sqrt(power(b.x - a.x, 2) + power(b.z - a.z, 2)) AS distance,
  row_number() OVER (PARTITION BY a.place_id ORDER BY sqrt(power(b.x - a.x, 2) + power(b.z - a.z, 2)), b.place_id) AS k FROM places a JOIN places b ON a.place_id <> b.place_id) WHERE k <= 4),
fw AS (SELECT *, CASE WHEN abs(dx) <= 0.25 AND abs(dz) <= 0.25 THEN NULL WHEN abs(dz) >= abs(dx) THEN CASE WHEN dz > 0 THEN 'NORTH_OF' ELSE 'SOUTH_OF' END WHEN dx > 0 THEN 'EAST_OF' ELSE 'WEST_OF' END AS direction FROM nb),
edges AS (SELECT DISTINCT source, target, direction, dx, dz, distance FROM (
  SELECT a AS source, b AS target, direction, dx, dz, distance FROM fw WHERE direction IS NOT NULL
  UNION ALL SELECT b, a, MAP {'NORTH_OF': 'SOUTH_OF', 'SOUTH_OF': 'NORTH_OF', 'EAST_OF': 'WEST_OF', 'WEST_OF': 'EAST_OF'}[direction], 0 - dx, 0 - dz, distance FROM fw WHERE direction IS NOT NULL))"""
GRAPH = f"{WITH}{PLACE_TABLE}"
SOME_PLACE = "place_00003"


def _graph(spark, d):
    """Places, views with places, place-object edges, direction edges."""
    v = derived_views(spark, d)
    p = graph.places(v)
    return p, graph.views_of_places(v, p), graph.place_object_edges(derived_observations(spark, d)), graph.direction_edges(p)


@query(f"{GRAPH} SELECT place_id, first_view, x, z, n_views, array_to_string(scan_angles, ',') AS scan_angles, room_function, view_type FROM places")
def places(spark, d):
    return graph.places(derived_views(spark, d)).select("place_id", "first_view", "x", "z", "n_views", F.array_join(F.transform("scan_angles", lambda a: a.cast("string")), ",").alias("scan_angles"), "room_function", "view_type")


@query(f"{WITH} SELECT place_no, label FROM (SELECT place_no, label, row_number() OVER (PARTITION BY place_no ORDER BY count(*) DESC, label) AS k FROM obs GROUP BY place_no, label) WHERE k = 1")
def place_majority(spark, d):
    return graph.majority(derived_observations(spark, d), ["place_no"], "label", "label")


@query(f"{GRAPH} SELECT source, target, direction, dx, dz, round(distance, 6) AS distance FROM edges")
def direction_edges(spark, d):
    return _graph(spark, d)[3].select("source", "target", "direction", (F.col("dx") + 0).alias("dx"), (F.col("dz") + 0).alias("dz"), _r("distance"))


@query(f"{GRAPH}, n2 AS (SELECT a.place_id AS a, b.place_id AS b, b.x - a.x AS dx, b.z - a.z AS dz, sqrt(power(b.x - a.x, 2) + power(b.z - a.z, 2)) AS distance FROM places a JOIN places b ON a.place_id <> b.place_id) SELECT a, b, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS k FROM n2 WHERE distance <= 3) WHERE k <= 3")
def places_within_radius(spark, d):
    return graph.neighbour_pairs(graph.places(derived_views(spark, d)), 3, 3.0).select(F.col("a_place_id").alias("a"), F.col("b_place_id").alias("b"), _r("distance"))


@query(f"{GRAPH} SELECT a.place_id, a.view_id AS source_view, b.view_id AS target_view FROM vp a JOIN vp b ON a.place_id = b.place_id AND a.view_id <> b.view_id")
def view_view_edges(spark, d):
    return graph.view_view_edges(_graph(spark, d)[1])


@query(f"{GRAPH} SELECT 'places' AS what, count(*) AS n FROM places UNION ALL SELECT 'views', count(*) FROM vp UNION ALL SELECT 'objects', count(*) FROM po UNION ALL SELECT 'direction_edges', count(*) FROM edges UNION ALL SELECT 'labels', count(DISTINCT label) FROM po")
def graph_summary(spark, d):
    return graph.summary(*_graph(spark, d))


@query(f"{GRAPH} SELECT 'view' AS kind, view_id AS item FROM vp WHERE place_id = '{SOME_PLACE}' UNION ALL SELECT 'object', obs_id FROM po WHERE place_id = '{SOME_PLACE}'")
def graph_same_node(spark, d):
    _, v, o, _ = _graph(spark, d)
    return graph.same_node(o, v, SOME_PLACE)


@query(f"{GRAPH} SELECT target, direction, round(distance, 6) AS distance, room_function, n_views FROM edges JOIN places ON place_id = target WHERE source = '{SOME_PLACE}' AND direction = 'WEST_OF'")
def graph_direction_neighbors(spark, d):
    p, _, _, e = _graph(spark, d)
    return graph.direction_neighbours(e, p, SOME_PLACE, "west").withColumn("distance", F.round("distance", 6))


@query(f"{GRAPH} SELECT place_id, obs_id, object_global_id, label, view_id FROM po WHERE place_id = '{SOME_PLACE}' AND label = 'mirror'")
def graph_place_objects(spark, d):
    return graph.place_objects(_graph(spark, d)[2], SOME_PLACE, "mirror")


@query(f"{GRAPH} SELECT place_id, count(*) AS n_objects, count(DISTINCT view_id) AS n_views FROM po WHERE lower(label) = 'mirror' GROUP BY place_id")
def graph_places_for_object(spark, d):
    return graph.places_for_object(_graph(spark, d)[2], "MIRROR")


@query(f"{GRAPH} SELECT po.place_id, round(distance, 6) AS distance, obs_id, object_global_id, label, view_id FROM edges JOIN po ON po.place_id = target WHERE source = '{SOME_PLACE}' AND direction = 'NORTH_OF'")
def graph_direction_objects(spark, d):
    _, _, o, e = _graph(spark, d)
    return graph.direction_objects(e, o, SOME_PLACE, "north").withColumn("distance", F.round("distance", 6))


@query(f"{WITH} SELECT label, count(*) AS n FROM obs GROUP BY label ORDER BY n DESC, label LIMIT 5")
def graph_top_labels(spark, d):
    return graph.top_labels(derived_observations(spark, d), 5)


@query(f"""{GRAPH}, sn AS (SELECT object_global_id AS id, place_id, label || ': ' || description AS s FROM obs), rk AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY id) AS r FROM sn),
sm AS (SELECT id, string_agg(s, '; ' ORDER BY o) AS same FROM (SELECT a.id, b.id AS o, b.s, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS k FROM sn a JOIN rk b ON a.place_id = b.place_id AND b.r <= 9 AND b.id <> a.id) WHERE k <= 8 GROUP BY id),
ar AS (SELECT source, direction, string_agg(s, '; ' ORDER BY distance, id, s) AS text FROM (SELECT e.source, e.direction, e.distance, rk.id, rk.s, row_number() OVER (PARTITION BY e.source, e.direction ORDER BY e.distance, rk.id, rk.s) AS k FROM edges e JOIN rk ON rk.place_id = e.target AND rk.r <= 4) WHERE k <= 4 GROUP BY ALL),
li AS (SELECT source, string_agg(lower(replace(direction, '_OF', '')) || ': ' || text, ' | ' ORDER BY direction) AS around FROM ar GROUP BY source)
SELECT sn.id AS object_global_id, concat_ws(' | ', 'place=' || place_id, s, same, around) AS context FROM sn LEFT JOIN sm ON sm.id = sn.id LEFT JOIN li ON li.source = sn.place_id""")
def graph_context_strings(spark, d):
    o = derived_observations(spark, d)
    return graph.context_strings(o, _graph(spark, d)[3], F.concat_ws(": ", "label", "description"))


# pairs within a place

PAIRS = f"""{WITH}, pr AS (SELECT a.place_id, a.object_global_id AS i, b.object_global_id AS j, a.view_id = b.view_id AS sv, a.label AS il, b.label AS jl,
  round(greatest(-1, least(1, list_inner_product(a.vec, b.vec) / (sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec))))), 9) AS sim,
  sqrt(power(b.gx - a.gx, 2) + power(b.gz - a.gz, 2)) AS d2, sqrt(power(b.gx - a.gx, 2) + power(b.gy - a.gy, 2) + power(b.gz - a.gz, 2)) AS d3
  FROM obs a JOIN obs b ON a.place_id = b.place_id AND a.object_global_id < b.object_global_id),
fu AS (SELECT *, CASE WHEN d3 IS NOT NULL THEN 0.7 * sim + 0.3 * exp(-(d3 * d3) / 6.25) ELSE sim END AS fused FROM pr),
bw AS (SELECT place_id, i AS a, j AS b, round(sim, 9) AS w FROM pr UNION ALL SELECT place_id, j, i, round(sim, 9) FROM pr)"""


def _sims(spark, d):
    sims = similarity.text_similarity(derived_observations(spark, d), "place_id", ("view_id", "label"))
    return sims.withColumn("sim", F.round("sim", 9))


@query(f"{PAIRS} SELECT place_id, i, j, round(sim, 6) AS sim FROM pr")
def pair_similarity(spark, d):
    return _sims(spark, d).select("place_id", "i", "j", _r("sim"))


@query(f"{PAIRS} SELECT place_id, i, j, round(CASE WHEN sim >= 0.1 THEN greatest(0, least(1, CASE WHEN sv THEN sim * 0.8 ELSE sim END)) ELSE 0 END, 6) AS affinity FROM pr")
def affinity_soft(spark, d):
    return similarity.constrained(_sims(spark, d), "place_id", least=0.1).select("place_id", "i", "j", _r("affinity"))


@query(f"{PAIRS} SELECT place_id, i, j, round(CASE WHEN sv THEN 0 ELSE greatest(0, least(1, sim)) END, 6) AS affinity FROM pr")
def affinity_hard(spark, d):
    return similarity.constrained(_sims(spark, d), "place_id", "hard_block").select("place_id", "i", "j", _r("affinity"))


@query(f"""{PAIRS}, tk AS (SELECT DISTINCT place_id, least(a, b) AS i, greatest(a, b) AS j FROM (SELECT *, row_number() OVER (PARTITION BY place_id, a ORDER BY w DESC, b) AS k FROM bw WHERE w > 0) WHERE k <= 3)
SELECT pr.place_id, pr.i, pr.j, round(CASE WHEN tk.i IS NOT NULL THEN greatest(0, least(1, sim)) ELSE 0 END, 6) AS affinity FROM pr LEFT JOIN tk ON tk.i = pr.i AND tk.j = pr.j""")
def affinity_topk(spark, d):
    return similarity.constrained(_sims(spark, d), "place_id", "none", top_k=3).select("place_id", "i", "j", _r("affinity"))


@query(f"{PAIRS} SELECT place_id, i, j, round(CASE WHEN sim < 0.2 THEN 0 WHEN sv THEN greatest(0, least(1, sim)) * 0.8 ELSE greatest(0, least(1, sim)) END, 6) AS affinity FROM pr")
def affinity_multi_view(spark, d):
    return similarity.multi_view(_sims(spark, d), least=0.2).select("place_id", "i", "j", _r("affinity"))


@query(f"{PAIRS}, kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_id, a ORDER BY w DESC, b) AS k FROM bw) WHERE k <= 6) SELECT place_id, least(a, b) AS i, greatest(a, b) AS j, round(greatest(0, least(1, sum(w) / 2)), 6) AS weight FROM kn GROUP BY ALL")
def knn_graph(spark, d):
    return similarity.knn_graph(_sims(spark, d), "place_id").select("place_id", "i", "j", _r("weight"))


@query(f"{PAIRS} SELECT place_id, i, j, round(d2, 6) AS distance_2d, round(d3, 6) AS distance_3d, d3 IS NOT NULL AS used_3d, round(exp(-(d3 * d3) / 6.25), 6) AS geometry FROM pr")
def geometry_similarity(spark, d):
    g = similarity.geometry(derived_observations(spark, d), "place_id")
    return g.select("place_id", "i", "j", _r("distance_2d"), _r("distance_3d"), "used_3d", _r("geometry"))


def _fused(spark, d):
    return similarity.fused(_sims(spark, d), similarity.geometry(derived_observations(spark, d), "place_id"), "place_id")


@query(f"{PAIRS} SELECT place_id, i, j, round(fused, 6) AS fused, round(CASE WHEN sv THEN fused * 0.8 ELSE fused END, 6) AS fused_after FROM fu")
def fused_similarity(spark, d):
    return _fused(spark, d).select("place_id", "i", "j", _r("fused"), _r("fused_after"))


@query(f"{PAIRS} SELECT place_id, i, j, il AS label_i, jl AS label_j, sv AS same_view, round(sim, 6) AS text, round(fused, 6) AS fused, row_number() OVER (PARTITION BY place_id ORDER BY round(fused, 6) DESC, i, j) AS rank FROM fu")
def pair_breakdown(spark, d):
    f = _fused(spark, d).withColumn("fused", F.round("fused", 6))
    order = Window.partitionBy("place_id").orderBy(F.desc("fused"), "i", "j")
    return f.select("place_id", "i", "j", F.col("i_label").alias("label_i"), F.col("j_label").alias("label_j"), similarity.same_view().alias("same_view"), F.round("sim", 6).alias("text"), "fused", F.row_number().over(order).alias("rank"))


@query(f"""{PAIRS} SELECT place_id, round(max(round(sim, 9)), 6) AS hi, round(min(round(sim, 9)), 6) AS lo, round(avg(CASE WHEN il = jl THEN round(sim, 9) END), 6) AS mean_same_label, round(avg(CASE WHEN il <> jl THEN round(sim, 9) END), 6) AS mean_other_label,
arg_min(i, (0 - round(sim, 9), i, j)) AS hi_i, arg_min(j, (0 - round(sim, 9), i, j)) AS hi_j, arg_min(i, (round(sim, 9), i, j)) AS lo_i, arg_min(j, (round(sim, 9), i, j)) AS lo_j FROM pr GROUP BY place_id""")
def pair_extremes(spark, d):
    x = rooms.pair_extremes(_sims(spark, d), ["place_id"], "sim")
    return x.select("place_id", _r("hi"), _r("lo"), _r("mean_same_label"), _r("mean_other_label"), "hi_i", "hi_j", "lo_i", "lo_j")


# clusters: the label as cluster within a place, and those that are computed


def _labelled(spark, d):
    return derived_observations(spark, d).select("place_id", F.col("label_no").cast("long").alias("cluster"), "object_global_id")


@query(f"{WITH}, h AS (SELECT place_id, label_no AS cluster, label, count(*) AS n FROM obs GROUP BY ALL) SELECT o.place_id, o.label_no::BIGINT AS cluster, count(*) AS size, array_to_string(list_sort(list(object_global_id)), ',') AS members, count(*) > count(DISTINCT view_id) AS same_view_collision, count(DISTINCT view_id) AS n_views, any_value(h.label || '=' || h.n) AS histogram FROM obs o JOIN h ON h.place_id = o.place_id AND h.cluster = o.label_no GROUP BY ALL")
def cluster_summary(spark, d):
    s = clustering.summaries(_labelled(spark, d), derived_observations(spark, d), "place_id")
    shown = F.array_join(F.transform(F.map_entries("label_histogram"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return s.select("place_id", "cluster", "size", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "same_view_collision", "n_views", shown.alias("histogram"))


@query(f"""{PAIRS}, m AS (SELECT o.place_id, o.label_no AS cluster, o.object_global_id AS id, (1 + coalesce(sum(w) FILTER (WHERE x.label_no = o.label_no), 0)) / any_value(n) AS mean_sim
  FROM obs o JOIN (SELECT place_id, label_no, count(*) AS n FROM obs GROUP BY ALL) c ON c.place_id = o.place_id AND c.label_no = o.label_no LEFT JOIN bw ON bw.a = o.object_global_id LEFT JOIN obs x ON x.object_global_id = bw.b GROUP BY ALL)
SELECT place_id, cluster::BIGINT AS cluster, id AS medoid, round(mean_sim, 6) AS mean_sim FROM (SELECT *, row_number() OVER (PARTITION BY place_id, cluster ORDER BY round_even(mean_sim, 9) DESC, id) AS k FROM m) WHERE k = 1""")
def cluster_medoid(spark, d):
    return clustering.medoids(_labelled(spark, d), _sims(spark, d), "place_id").select("place_id", "cluster", "medoid", _r("mean_sim"))


@query(f"{WITH} SELECT place_id, object_global_id, (dense_rank() OVER (PARTITION BY place_id ORDER BY m) - 1)::INT AS cluster FROM (SELECT *, min(object_global_id) OVER (PARTITION BY place_id, label_no) AS m FROM obs)")
def cluster_relabel(spark, d):
    return clustering.relabelled(_labelled(spark, d), "place_id").select("place_id", "object_global_id", "cluster")


@query(f"""{WITH}, c AS (SELECT place_id, CASE WHEN label_no = 9 THEN -1 ELSE label_no END AS cluster, object_global_id FROM obs),
n AS (SELECT *, count(*) OVER (PARTITION BY place_id, cluster) AS n, min(object_global_id) OVER (PARTITION BY place_id, cluster) AS m FROM c),
w AS (SELECT *, row_number() OVER o - 1 AS position, coalesce(lead(cluster) OVER o <> cluster, false) AS block_end FROM n WINDOW o AS (PARTITION BY place_id ORDER BY cluster < 0, n DESC, m, cluster, object_global_id))
SELECT place_id, cluster::BIGINT AS cluster, object_global_id, position::INT AS position, block_end FROM w""")
def block_order(spark, d):
    noisy = _labelled(spark, d).withColumn("cluster", F.when(F.col("cluster") == 9, -1).otherwise(F.col("cluster")))
    return clustering.block_order(noisy, "place_id").select("place_id", "cluster", "object_global_id", "position", "block_end")


@query(f"{WITH} SELECT a.place_id, a.label_no::BIGINT AS cluster, a.object_global_id AS i, b.object_global_id AS j FROM obs a JOIN obs b ON a.place_id = b.place_id AND a.label_no = b.label_no AND a.object_global_id < b.object_global_id")
def co_cluster_pairs(spark, d):
    return clustering.co_clusters(_labelled(spark, d), "place_id")


@query(f"""WITH RECURSIVE {OBS_SQL}, l AS (SELECT a.object_global_id AS a, b.object_global_id AS b FROM obs a JOIN obs b ON a.place_id = b.place_id AND a.label = b.label AND a.object_global_id < b.object_global_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY node""")
def components_positive_pairs(spark, d):
    o = derived_observations(spark, d)
    a = o.select("place_id", "label", F.col("object_global_id").alias("a"))
    links = a.join(o.select("place_id", "label", F.col("object_global_id").alias("b")), ["place_id", "label"]).where("a < b")
    return components.connected_components(links, "a", "b")


@query()
def spectral_clusters(spark, d):
    affinity = similarity.constrained(_sims(spark, d), "place_id", least=0.2)
    return clustering.spectral_clusters(derived_observations(spark, d), affinity, "place_id")


@query()
def dbscan_clusters(spark, d):
    return clustering.density_clusters(derived_observations(spark, d), similarity.knn_graph(_sims(spark, d), "place_id"), "place_id")


def _sequence(spark, d):
    o = derived_observations(spark, d)
    scene = F.format_string("scene_%05d", F.floor(F.col("place_no") / 2).cast("long"))
    return o.select(scene.alias("scene"), F.col("entry_id").cast("int").alias("step"), "object_global_id", "view_id", "label", "vec", "gx", "gy", "gz", "distance_m", "bearing_deg", "height_m")


@query()
def incremental_clusters(spark, d):
    return incremental.resolve(_sequence(spark, d))


# mining


def _tok(t):
    return f"list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', {t}.label, {t}.description)), '[a-z0-9]+'), lambda x: length(x) >= 3))"


JACCARD = "len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::DOUBLE"
MINED = f"""{GRAPH}, ad AS (SELECT DISTINCT source, target FROM edges UNION SELECT target, source FROM edges),
c AS (SELECT a.object_global_id AS ai, b.object_global_id AS bi, a.label AS al, b.label AS bl, a.place_id AS ap, b.place_id AS bp, a.view_id <> b.view_id AS other_view, {_tok('a')} AS ta, {_tok('b')} AS tb,
  sqrt(power(a.gx - b.gx, 2) + power(a.gz - b.gz, 2)) AS d, a.distance_bin = b.distance_bin AS sd, a.laterality = b.laterality AS sl, a.verticality = b.verticality AS sv, ad.source IS NOT NULL AS adjacent
  FROM obs a JOIN obs b ON a.object_global_id < b.object_global_id AND (a.label = b.label OR a.place_id = b.place_id) LEFT JOIN ad ON ad.source = a.place_id AND ad.target = b.place_id),
s AS (SELECT *, CASE WHEN al <> bl THEN 'different_label_same_place' WHEN ap = bp THEN 'same_label_same_place' WHEN adjacent THEN 'same_label_adjacent_place' ELSE 'same_label_distant_place' END AS bucket, {JACCARD} AS jac FROM c),
sc AS (SELECT *, round(CASE bucket WHEN 'different_label_same_place' THEN 0.25 + CASE WHEN sd THEN 0.5 ELSE 0 END + CASE WHEN sl THEN 0.25 ELSE 0 END + CASE WHEN sv THEN 0.25 ELSE 0 END
  WHEN 'same_label_same_place' THEN 1.5 + jac + CASE WHEN other_view THEN 0.25 ELSE 0 END + coalesce(greatest(0, 1 - least(d, 4) / 4), 0)
  WHEN 'same_label_adjacent_place' THEN 1 + jac + coalesce(greatest(0, 1 - least(d, 6) / 6), 0) ELSE jac + coalesce(greatest(0, 1 - least(d, 10) / 10), 0) END::DOUBLE, 9) AS score FROM s)"""


@query(f"{MINED} SELECT bucket, round(score, 6) AS score, ai AS obj_a_id, bi AS obj_b_id, rank, bucket IN ('same_label_same_place', 'same_label_adjacent_place') AS suggested_same FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, ai, bi) AS rank FROM sc) WHERE rank <= 50")
def mine_pairs(spark, d):
    return mining.candidate_pairs(derived_observations(spark, d), _graph(spark, d)[3]).select("bucket", _r("score"), "obj_a_id", "obj_b_id", "rank", "suggested_same")


@query(f"{WITH}, t AS (SELECT a.object_global_id AS i, b.object_global_id AS j, {_tok('a')} AS ta, {_tok('b')} AS tb FROM obs a JOIN obs b ON a.place_id = b.place_id AND a.object_global_id < b.object_global_id) SELECT i, j, round({JACCARD}, 6) AS jaccard FROM t")
def token_jaccard(spark, d):
    rows = derived_observations(spark, d).withColumn("t", texts.tokens(F.col("label"), F.col("description")))
    p = similarity.pairs(rows, "place_id", ["t"])
    return p.select("i", "j", F.round(texts.jaccard(F.col("i_t"), F.col("j_t")), 6).alias("jaccard"))


@query(f"{WITH}, o AS (SELECT *, description LIKE '%mirror%' AS tricky FROM obs), t AS (SELECT a.object_global_id AS obj_a_id, b.object_global_id AS obj_b_id, a.label, {_tok('a')} AS ta, {_tok('b')} AS tb FROM o a JOIN o b ON a.label = b.label AND a.object_global_id < b.object_global_id AND (a.tricky OR b.tricky)), s AS (SELECT *, round(1.5 + {JACCARD}, 9) AS score FROM t) SELECT obj_a_id, obj_b_id, label, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, obj_a_id, obj_b_id) AS rank FROM s ORDER BY score DESC, obj_a_id, obj_b_id LIMIT 50")
def tricky_pairs(spark, d):
    return mining.tricky_pairs(derived_observations(spark, d)).withColumn("score", F.round("score", 6))


# metrics: pairs within a place, positive if of one label; two representations

SCORED = f"{PAIRS}, sr AS (SELECT 'text' AS rep, i AS a, j AS b, (il = jl)::INT AS label, round(sim, 6) AS score FROM pr UNION ALL SELECT 'fused', i, j, (il = jl)::INT, round(fused, 6) FROM fu)"


def _scored(spark, d):
    f = _fused(spark, d)
    label = (F.col("i_label") == F.col("j_label")).cast("int").alias("label")
    one = lambda rep, c: f.select(F.lit(rep).alias("rep"), F.col("i").alias("a"), F.col("j").alias("b"), label, F.round(c, 6).alias("score"))
    return one("text", "sim").unionByName(one("fused", "fused"))


#: Each pair of a view is annotated twice, in either order, with the folder written in two ways; some belong to a test split.
GT_PAIRS = f"""{OBS_SQL}, w AS (SELECT a.object_global_id AS i, b.object_global_id AS j, (a.label = b.label) AS same FROM obs a JOIN obs b ON a.entry_id = b.entry_id AND a.object_global_id < b.object_global_id),
p AS (SELECT 'p' || i || '_' || j AS pair_id, '/data/db' || i % 3 AS db_dir, i AS a, j AS b, same, CASE WHEN j % 5 = 0 THEN 'test' WHEN j % 5 = 1 THEN NULL ELSE 'dev' END AS split FROM w
  UNION ALL SELECT 'q' || i || '_' || j, 'db' || i % 3 || '/', j, i, same, CASE WHEN j % 5 = 0 THEN 'test' ELSE 'dev' END FROM w WHERE i % 2 = 0)"""


def _gt_pairs(spark, d):
    o = derived_observations(spark, d)
    w = similarity.pairs(o, "entry_id", ["label"]).withColumn("same", F.col("i_label") == F.col("j_label"))
    split = F.when(F.col("j") % 5 == 0, "test").when(F.col("j") % 5 != 1, "dev")
    db = (F.col("i") % 3).cast("string")
    one = w.select(F.concat_ws("", F.lit("p"), "i", F.lit("_"), "j").alias("pair_id"), F.concat(F.lit("/data/db"), db).alias("db_dir"), F.col("i").alias("obj_a_id"), F.col("j").alias("obj_b_id"), F.col("same").alias("is_same_instance"), split.alias("split"))
    two = w.where("i % 2 = 0").select(F.concat_ws("", F.lit("q"), "i", F.lit("_"), "j"), F.concat(F.lit("db"), db, F.lit("/")), "j", "i", "same", F.when(F.col("j") % 5 == 0, "test").otherwise("dev"))
    return one.union(two)


@query(f"WITH {GT_PAIRS} SELECT regexp_extract(db_dir, '([^/]+)/*$', 1) AS db, least(a, b)::BIGINT AS a, greatest(a, b)::BIGINT AS b, min(pair_id) AS pair_id, bool_and(same)::INT AS label FROM p WHERE coalesce(split, 'dev') = 'dev' GROUP BY 1, 2, 3")
def gt_pair_dedupe(spark, d):
    return metrics.normalised_pairs(_gt_pairs(spark, d), "dev")


@query(f"{SCORED}, k AS (SELECT *, rank() OVER (PARTITION BY rep ORDER BY score) + (count(*) OVER (PARTITION BY rep, score) - 1) / 2::DOUBLE AS r FROM sr) SELECT rep, sum(label) AS pos, count(*) - sum(label) AS neg, round((sum(r * label) - sum(label) * (sum(label) + 1) / 2::DOUBLE) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM k GROUP BY rep")
def pair_roc_auc(spark, d):
    return metrics.roc_auc(_scored(spark, d), ["rep"]).withColumn("auc", F.round("auc", 6))


@query(f"{SCORED}, k AS (SELECT *, row_number() OVER w AS r, sum(label) OVER w AS hit FROM sr WINDOW w AS (PARTITION BY rep ORDER BY score DESC, a * 100000 + b)) SELECT rep, round(sum(CASE WHEN label = 1 THEN hit / r::DOUBLE END) / sum(label), 6) AS ap FROM k GROUP BY rep")
def pair_average_precision(spark, d):
    s = _scored(spark, d).withColumn("position", F.col("a") * 100000 + F.col("b"))
    return metrics.average_precision(s, ["rep"], "position").withColumn("ap", F.round("ap", 6))


@query(f"""{SCORED}, th AS (SELECT DISTINCT rep, score AS t FROM sr UNION ALL SELECT rep, min(score) - 1e-6 FROM sr GROUP BY rep),
c AS (SELECT rep, score, sum(label) AS p, count(*) AS n FROM sr GROUP BY ALL),
k AS (SELECT th.rep, t, sum(p) FILTER (WHERE score >= t) AS tp, sum(n) FILTER (WHERE score >= t) AS called, sum(p) AS pos, sum(n) AS n FROM th JOIN c USING (rep) GROUP BY th.rep, t),
m AS (SELECT rep, t, tp, called - tp AS fp, pos - tp AS fn, tp / called::DOUBLE AS pr, tp / pos::DOUBLE AS re, (n - called + 2 * tp - pos) / n::DOUBLE AS acc FROM k),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m)
SELECT rep, round(t, 6) AS threshold, round(f1, 6) AS f1, round(acc, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY f1 DESC, acc DESC, t) AS k FROM f) WHERE k = 1""")
def pair_best_threshold(spark, d):
    b = metrics.best_threshold(_scored(spark, d), ["rep"])
    return b.select("rep", *(_r(c) for c in ("threshold", "f1", "accuracy", "precision", "recall")), "tp", "fp", "fn")


@query(f"{SCORED}, bo AS (SELECT rep, a AS anchor, b AS other, label, score FROM sr UNION ALL SELECT rep, b, a, label, score FROM sr), k AS (SELECT *, row_number() OVER (PARTITION BY rep, anchor ORDER BY score DESC, other) AS r FROM bo), f AS (SELECT rep, anchor, min(r) AS r FROM k WHERE label = 1 GROUP BY ALL) SELECT rep, count(*) AS anchors, round(avg((r <= 1)::INT), 6) AS recall_1, round(avg((r <= 5)::INT), 6) AS recall_5, round(avg(1 / r::DOUBLE), 6) AS mrr FROM f GROUP BY rep")
def pair_retrieval_metrics(spark, d):
    m = metrics.retrieval(_scored(spark, d), ["rep"])
    return m.select("rep", "anchors", _r("recall_1"), _r("recall_5"), _r("mrr"))


@query(f"{SCORED} SELECT rep, round(avg(score) FILTER (WHERE label = 1), 6) AS mean_pos, round(avg(score) FILTER (WHERE label = 0), 6) AS mean_neg, round(median(score) FILTER (WHERE label = 1), 6) AS median_pos, round(median(score) FILTER (WHERE label = 0), 6) AS median_neg, count(*) AS n FROM sr GROUP BY rep")
def pair_class_means(spark, d):
    m = metrics.means_by_class(_scored(spark, d), ["rep"])
    return m.select("rep", *(_r(c) for c in ("mean_pos", "mean_neg", "median_pos", "median_neg")), "n")


@query(f"{WITH} SELECT round(avg(distance_m), 6) AS mean_m, round(median(distance_m), 6) AS median_m, round(quantile_cont(distance_m, 0.9), 6) AS p90_m, round(avg(abs(bearing_deg)), 6) AS mean_yaw, count(*) AS n FROM obs")
def batch_error_metrics(spark, d):
    m = metrics.errors(derived_observations(spark, d).withColumn("yaw", F.abs("bearing_deg")), "distance_m", "yaw")
    return m.select(*(_r(c) for c in ("mean_m", "median_m", "p90_m", "mean_yaw")), "n")


SETS = f"{WITH}, st AS (SELECT entry_id, coalesce(list(DISTINCT label) FILTER (WHERE object_global_id % 3 <> 0), []) AS t, coalesce(list(DISTINCT label) FILTER (WHERE object_global_id % 4 <> 0), []) AS p FROM obs GROUP BY entry_id), sm AS (SELECT entry_id, len(list_intersect(t, p))::INT AS tp, len(p)::INT - len(list_intersect(t, p))::INT AS fp, len(t)::INT - len(list_intersect(t, p))::INT AS fn FROM st), sj AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE tp / (tp + fp + fn)::DOUBLE END AS jaccard, tp > 0 OR tp + fp + fn = 0 AS hit FROM sm)"


def _sets(spark, d):
    o = derived_observations(spark, d)
    picked = lambda m: F.collect_set(F.when(F.col("object_global_id") % m != 0, F.col("label")))
    return metrics.set_metrics(o.groupBy("entry_id").agg(picked(3).alias("t"), picked(4).alias("p")), "t", "p")


@query(f"{SETS} SELECT entry_id, tp, fp, fn, round(jaccard, 6) AS jaccard, hit FROM sj")
def set_metrics(spark, d):
    return _sets(spark, d).select("entry_id", "tp", "fp", "fn", _r("jaccard"), "hit")


@query(f"{SETS} SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE, 6) AS micro_f1, round(avg(jaccard), 6) AS mean_jaccard, round(avg(hit::INT), 6) AS accuracy FROM sj")
def set_metrics_summary(spark, d):
    m = metrics.set_summary(_sets(spark, d))
    return m.select(_r("micro_f1"), _r("mean_jaccard"), _r("accuracy"))


# rooms

ROOMS = f"""{GRAPH}, ro AS (SELECT o.*, p.room_function, p.view_type FROM obs o JOIN places p ON p.place_id = o.place_id WHERE lower(label) NOT IN ('unknown', 'none', 'other')),
rl AS (SELECT room_function, view_type, label, count(*) AS n FROM ro GROUP BY ALL),
rs AS (SELECT room_function, view_type, sum(n)::BIGINT AS num_objects, count(*) AS num_unique_labels, max(n) AS max_label_count, string_agg(label || '=' || n, ',' ORDER BY label || '=' || n) FILTER (WHERE n > 1) AS repeated_labels FROM rl GROUP BY ALL),
rooms AS (SELECT *, 'room_' || lpad((row_number() OVER (ORDER BY room_function, view_type) - 1)::VARCHAR, 3, '0') AS room_id, num_objects - num_unique_labels AS duplicate_objects, num_unique_labels / num_objects::DOUBLE AS unique_label_ratio FROM rs),
rp AS (SELECT room_function, view_type, array_to_string(list_sort(list(DISTINCT place_id)), ',') AS place_ids FROM ro GROUP BY ALL)"""


def _rooms(spark, d):
    return rooms.semantic_rooms(derived_observations(spark, d), graph.places(derived_views(spark, d)))


@query(f"{ROOMS} SELECT room_id, room_function, view_type, num_objects, num_unique_labels, max_label_count, coalesce(repeated_labels, '') AS repeated_labels, duplicate_objects, round(unique_label_ratio, 6) AS unique_label_ratio, place_ids FROM rooms JOIN rp USING (room_function, view_type) WHERE num_objects >= 3")
def semantic_rooms(spark, d):
    return _rooms(spark, d).select("room_id", "room_function", "view_type", "num_objects", "num_unique_labels", "max_label_count", "repeated_labels", "duplicate_objects", _r("unique_label_ratio"), F.array_join("place_ids", ",").alias("place_ids"))


@query(f"""{ROOMS}, si AS (SELECT * FROM rooms WHERE num_objects >= 3 ORDER BY unique_label_ratio DESC, duplicate_objects, num_unique_labels DESC, room_function, view_type, room_id LIMIT 1),
co AS (SELECT * FROM rooms WHERE num_objects >= 3 AND duplicate_objects > 0 AND room_id NOT IN (SELECT room_id FROM si) ORDER BY duplicate_objects DESC, max_label_count DESC, num_objects DESC, room_function, view_type, room_id LIMIT 1)
SELECT 'simple' AS kind, room_id, num_objects FROM si UNION ALL SELECT 'complex', room_id, num_objects FROM co""")
def room_selection(spark, d):
    return rooms.select_rooms(_rooms(spark, d)).select("kind", "room_id", "num_objects")


@query(f"""{WITH}, n AS (SELECT *, count(*) OVER (PARTITION BY place_id, label) AS n, row_number() OVER (PARTITION BY place_id, label ORDER BY entry_id, object_global_id) AS k FROM obs),
t AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY CASE WHEN n > 1 AND k <= 2 THEN 0 WHEN n = 1 THEN 1 ELSE 2 END, CASE WHEN n > 1 THEN -n ELSE 0 END, label, k) AS pick FROM n)
SELECT place_id AS room_id, object_global_id, label, pick FROM t WHERE pick <= 8""")
def room_sample(spark, d):
    return rooms.sample_objects(derived_observations(spark, d).withColumn("room_id", F.col("place_id")), "complex").select("room_id", "object_global_id", "label", "pick")


# detections, depth, upkeep

BOXES = f"""{WITH}, b AS (SELECT object_global_id, label, (object_global_id * 17 % 100) / 100::DOUBLE AS confidence, (object_global_id * 31 % 700 - 20)::DOUBLE AS x1, (object_global_id * 37 % 500 - 10)::DOUBLE AS y1, (object_global_id * 31 % 700 - 20 + object_global_id * 11 % 300)::DOUBLE AS x2, (object_global_id * 37 % 500 - 10 + object_global_id * 19 % 260)::DOUBLE AS y2 FROM obs),
cl AS (SELECT object_global_id, label, confidence, greatest(0, least(x1::INT, 639)) AS x1, greatest(0, least(y1::INT, 479)) AS y1, greatest(0, least(x2::INT, 639)) AS x2, greatest(0, least(y2::INT, 479)) AS y2 FROM b WHERE confidence >= 0.35),
ok AS (SELECT *, (x2 - x1) * (y2 - y1) / (640 * 480)::DOUBLE AS area_ratio FROM cl WHERE x2 - x1 >= 32 AND y2 - y1 >= 32)"""


@query(f"{BOXES} SELECT object_global_id, label, confidence, x1, y1, x2, y2, round(area_ratio, 6) AS area_ratio, CASE WHEN (x1 + x2) / 2::DOUBLE < 640 / 3::DOUBLE THEN 'left' WHEN (x1 + x2) / 2::DOUBLE > 1280 / 3::DOUBLE THEN 'right' ELSE 'center' END AS side FROM ok WHERE area_ratio BETWEEN 0.005 AND 0.6")
def detections_filter(spark, d):
    i = F.col("object_global_id")
    x, y = (i * 31 % 700 - 20).cast("double"), (i * 37 % 500 - 10).cast("double")
    boxes = derived_observations(spark, d).select(i, "label", ((i * 17 % 100) / 100).alias("confidence"), x.alias("x1"), y.alias("y1"), (x + i * 11 % 300).alias("x2"), (y + i * 19 % 260).alias("y2"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    good = detections.valid_detections(boxes)
    return good.select("object_global_id", "label", "confidence", "x1", "y1", "x2", "y2", _r("area_ratio"), detections.box_laterality(F.col("x1"), F.col("x2"), F.col("width")).alias("side"))


@query("""WITH g AS (SELECT user_id, value, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k FROM events WHERE value > 0 AND isfinite(value))
SELECT user_id, count(*) AS n, round(median(value), 6) AS median, round(median(value) FILTER (WHERE n <= 2 * floor(n * 0.1) OR (k > floor(n * 0.1) AND k <= n - floor(n * 0.1))), 6) AS trimmed_median, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM g GROUP BY user_id""")
def depth_stats(spark, d):
    s = detections.depth_statistics(spark.read.parquet(f"{d}/events.parquet"), ["user_id"], "value")
    return s.select("user_id", "n", _r("median"), _r("trimmed_median"), _r("p10"), _r("p90"))


@query("SELECT metric, round(avg(value), 4) AS mean, count(value) AS n FROM (UNPIVOT (SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME metric VALUE value) GROUP BY metric")
def timing_averages(spark, d):
    return upkeep.timing_averages(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("mean", F.round("mean", 4))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def resume_antijoin(spark, d):
    done = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"))
    return upkeep.still_to_do(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), done, ["o_orderkey"])


@query("""WITH c AS (SELECT doc_id, md5(source || '|' || lang || '|' || doc_id) AS key FROM documents) SELECT doc_id, key FROM c WHERE doc_id % 3 = 0 OR doc_id % 5 = 1""")
def cache_misses(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", texts.content_key(F.col("source"), F.col("lang"), F.col("doc_id")).alias("key"))
    cut = F.when(F.col("doc_id") % 5 == 1, '{"choices":[{"finish_reason":"stop"},{"finish_reason":"Length "}]}').otherwise('{"choices":[{"finish_reason":"stop"}]}')
    cache = docs.where("doc_id % 3 <> 0").select("key", cut.alias("response"))
    return upkeep.cache_lookup(docs, cache, "key")[1]


@query(f"{WITH}, p AS (SELECT x, z FROM obs UNION ALL SELECT gx, gz FROM obs WHERE gx IS NOT NULL) SELECT round(min(x) - 0.5, 6) AS min_x, round(min(z) - 0.5, 6) AS min_z, round(max(x) + 0.5, 6) AS max_x, round(max(z) + 0.5, 6) AS max_z FROM p")
def projection_bounds(spark, d):
    o = derived_observations(spark, d)
    b = upkeep.projection_bounds(o.select("x", "z").unionByName(o.select(F.col("gx").alias("x"), F.col("gz").alias("z"))))
    return b.select(*(_r(c) for c in ("min_x", "min_z", "max_x", "max_z")))


@query(f"{WITH}, {HITS}, s AS (SELECT round_even(x, 3) AS x, round_even(z, 3) AS z, orientation, max(round(score, 9)) AS score FROM hits JOIN views ON id = entry_id GROUP BY ALL) SELECT x, z, arg_max(orientation, (score, -orientation)) AS best_orientation, round(max(score), 6) AS best, count(*) AS n FROM s GROUP BY x, z")
def overlay_groups(spark, d):
    best = products.best_of_queries(_asked(spark, d), _rows(spark, d), "entry_id").withColumn("score", F.round("score", 9))
    g = upkeep.overlay_groups(best.join(derived_views(spark, d).select(F.col("id").alias("entry_id"), "x", "z", "orientation"), "entry_id"))
    return g.select("x", "z", "best_orientation", _r("best"), F.size("scores").cast("long").alias("n"))


@query(f"{PAIRS}, b AS (SELECT min(round(sim, 9)) AS lo, max(round(sim, 9)) AS hi FROM pr) SELECT i, j, round((round(sim, 9) - lo) / (hi - lo), 6) AS linear, round(ln(1 + (round(sim, 9) - lo) / (hi - lo) * 24) / ln(25), 6) AS log FROM pr, b")
def display_values(spark, d):
    return upkeep.display_values(_sims(spark, d).select("i", "j", "sim"), "sim").select("i", "j", _r("linear"), _r("log"))


@query(f"{WITH}, p AS (SELECT DISTINCT place_no AS anchor_id, x, z FROM obs) SELECT anchor_id, side, x + dx AS x, z + dz AS z, orientation FROM p, (VALUES ('north', 0, -1, 180), ('east', 1, 0, 90), ('south', 0, 1, 0), ('west', -1, 0, 270)) t(side, dx, dz, orientation)")
def anchor_poses(spark, d):
    return upkeep.anchor_poses(derived_observations(spark, d).select(F.col("place_no").alias("anchor_id"), "x", "z").distinct())


# scene documents, one for each view: its objects as features, written in five ways


SCENE_SQL = f"""{WITH}, v AS (SELECT entry_id, entry_id % 5 AS kind, count(*) AS n, list(object_global_id ORDER BY object_global_id) AS ids, list(label ORDER BY object_global_id) AS labels,
  list(laterality ORDER BY object_global_id) AS sides, list(distance_bin ORDER BY object_global_id) AS bins, list(description ORDER BY object_global_id) AS texts FROM obs GROUP BY entry_id)"""


def _scene_documents(spark, d):
    o = derived_observations(spark, d)
    kind = F.col("entry_id") % 5
    feature = F.to_json(F.struct(
        F.initcap("label").alias("type"), F.col("description"), F.array(F.lit(" soft "), F.lit("")).alias("attributes"), F.upper("laterality").alias("laterality"), F.col("distance_bin").alias("distance"),
        F.col("distance_m").cast("string").alias("distance_from_camera_m"), F.array(F.struct(F.col("label"))).alias("surrounding_context"),
    ))
    old = F.to_json(F.struct(F.struct(F.col("label"), F.array(F.lit("red")).alias("attributes")).alias("meta"), F.struct(F.array(F.lit(0.0), F.lit(0.0), (F.col("object_global_id") % 4 + 1) / 4, F.lit(0.5)).alias("bbox_xywh_norm")).alias("location")))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("object_global_id", c.alias("t")))), lambda x: x["t"]), ",")
    views = o.groupBy("entry_id").agg(listed(feature).alias("new"), listed(old).alias("old"))
    wall = F.lit('{"type":"wall feature","description":"brick"}')
    text = (
        F.when(kind == 0, F.concat(F.lit('{"view_type":"Living_Room","room_function":"resting","scene_attributes":["bright"],"visual_feature":["odd",'), "new", F.lit(","), wall, F.lit("]}")))
        .when(kind == 1, F.concat(F.lit('Here it is: {"objects":[7,'), "old", F.lit("]} done")))
        .when(kind == 2, F.lit("no json")).when(kind == 3, F.concat(F.lit('{"others":['), "new", F.lit("]}"))).otherwise(F.concat(F.lit('{"view_types":1,"image_summary":"x","style_hint":"Baroque","visual_features":['), "new", F.lit("]}")))
    )
    return views.select("entry_id", text.alias("text"))


def _scenes(spark, d):
    return parsing.parse_scenes(_scene_documents(spark, d))


@query(f"""{SCENE_SQL} SELECT entry_id, CASE kind WHEN 0 THEN 'ok' WHEN 1 THEN 'legacy' WHEN 4 THEN 'ok' ELSE 'failed' END AS status, CASE kind WHEN 0 THEN 'living room' ELSE 'unknown' END AS view_type,
CASE kind WHEN 0 THEN 'resting' ELSE 'unknown' END AS room_function, CASE kind WHEN 0 THEN 'bright|wall detail: brick' ELSE '' END AS attributes, CASE WHEN kind IN (0, 1, 4) THEN n ELSE 0 END::INT AS n_features FROM v""")
def scene_json_parse(spark, d):
    return _scenes(spark, d).select("entry_id", "status", "view_type", "room_function", F.array_join("scene_attributes", "|").alias("attributes"), F.size("features").alias("n_features"))


@query(f"""{SCENE_SQL}, f AS (SELECT entry_id, kind, k, CASE kind WHEN 0 THEN k ELSE k - 1 END AS at, ids[k] AS id, labels[k] AS type, sides[k] AS side, bins[k] AS bin FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM v WHERE kind IN (0, 1, 4))),
g AS (SELECT entry_id, 'feat_' || lpad((k - 1)::VARCHAR, 3, '0') AS feature_id, type, CASE WHEN kind = 1 THEN CASE WHEN (id % 4 + 1) / 8 < 0.34 THEN 'left' WHEN (id % 4 + 1) / 8 < 0.67 THEN 'center' ELSE 'right' END ELSE side END AS laterality,
  CASE WHEN kind = 1 THEN CASE WHEN (id % 4 + 1) / 8 >= 0.18 THEN 'near' WHEN (id % 4 + 1) / 8 >= 0.06 THEN 'middle' ELSE 'far' END ELSE bin END AS distance, CASE kind WHEN 1 THEN 'high' ELSE 'middle' END AS verticality, CASE kind WHEN 1 THEN 'red' ELSE 'soft' END AS attributes, CASE kind WHEN 1 THEN 0 ELSE 1 END AS n_near FROM f)
SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY CASE laterality WHEN 'left' THEN 0 WHEN 'center' THEN 1 ELSE 2 END, CASE distance WHEN 'near' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END, CASE verticality WHEN 'high' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END, type, feature_id) AS rank FROM g""")
def scene_explode(spark, d):
    return parsing.explode_features(_scenes(spark, d), "entry_id").select("entry_id", "feature_id", "type", "laterality", "distance", "verticality", F.array_join("attributes", "|").alias("attributes"), F.size("surroundings").alias("n_near"), "rank")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean FROM events WHERE json_valid(props) GROUP BY event_type")
def event_json_summary(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.where(parsing.json_object(F.col("props")).isNotNull()).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"))


# records


@query(f"{SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY rep, label ORDER BY score, a, b) AS up, row_number() OVER (PARTITION BY rep, label ORDER BY score DESC, a, b) AS down FROM sr) SELECT rep, label, 'highest' AS \"end\", down AS rank, a, b, score FROM k WHERE down <= 5 UNION ALL SELECT rep, label, 'lowest', up, a, b, score FROM k WHERE up <= 5")
def example_buckets(spark, d):
    return records.example_buckets(_scored(spark, d), ["rep"], 5)


@query(f"{WITH}, {HITS}, b AS (SELECT query_id, entry_id, max(round(score, 9)) AS score FROM hits GROUP BY ALL) SELECT query_id, entry_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM b WHERE score >= 0.15) WHERE rank <= 5")
def cosine_retrieve(spark, d):
    best = products.best_groups(_asked(spark, d), _rows(spark, d), "entry_id", 5, 9).withColumn("score", F.round("score", 9))
    return records.best_of_entity(best, ["entry_id"], 0.15, 5).withColumn("score", F.round("score", 6))


@query(f"{WITH} SELECT o.object_global_id FROM obs o WHERE gx IS NOT NULL AND o.object_global_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM obs p WHERE p.object_global_id % 2 = 1 AND p.gx IS NOT NULL AND sqrt(power(o.gx - p.gx, 2) + power(o.gz - p.gz, 2)) < 0.5)")
def novel_positions(spark, d):
    o = derived_observations(spark, d).where("gx is not null").select("object_global_id", F.col("gx").alias("x"), F.col("gz").alias("z"))
    return records.far_from(o.where("object_global_id % 2 = 0"), o.where("object_global_id % 2 = 1"), 0.5).select("object_global_id")


@query(f"""WITH RECURSIVE {OBS_SQL}, l AS (SELECT a.object_global_id AS a, b.object_global_id AS b FROM obs a JOIN obs b ON a.entry_id = b.entry_id AND a.label = b.label AND a.object_global_id < b.object_global_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT (dense_rank() OVER (ORDER BY component) - 1)::INT AS group_no, node AS object_id, count(*) OVER (PARTITION BY component) AS size FROM c""")
def same_object_groups(spark, d):
    rows = derived_observations(spark, d)
    p = similarity.pairs(rows, "entry_id", ["label"]).select(F.col("i").alias("a"), F.col("j").alias("b"), (F.col("i_label") == F.col("j_label")).cast("int").alias("label"))
    return records.same_object_groups(p)


@query(f"{WITH} SELECT object_global_id, CASE WHEN object_global_id % 4 = 0 THEN CASE WHEN object_global_id % 8 = 0 THEN NULL ELSE 'new' END ELSE label END AS label, CASE WHEN object_global_id % 4 = 0 THEN 1 END AS extra FROM obs")
def merged_rows(spark, d):
    raw = derived_observations(spark, d).select("object_global_id", "label")
    payload = raw.where("object_global_id % 4 = 0").select("object_global_id", F.when(F.col("object_global_id") % 8 != 0, "new").alias("label"), F.lit(1).alias("extra"))
    return records.merged(raw, payload, "object_global_id")


@query(f"{WITH} SELECT object_global_id, round(CASE WHEN object_global_id % 5 = 0 AND distance_m IS NOT NULL THEN x - sin(radians(orientation - bearing_deg)) * distance_m ELSE gx END, 6) AS px, round(CASE WHEN object_global_id % 5 = 0 AND distance_m IS NOT NULL THEN z - cos(radians(orientation - bearing_deg)) * distance_m ELSE gz END, 6) AS pz FROM obs")
def located_objects(spark, d):
    o = derived_observations(spark, d).withColumn("gx", F.when(F.col("object_global_id") % 5 != 0, F.col("gx")))
    return records.located(o).select("object_global_id", _r("px"), _r("pz"))


@query(f"{WITH} SELECT size, count(*) AS n FROM (SELECT place_id, label_no, count(*) AS size FROM obs GROUP BY ALL) GROUP BY size")
def cluster_size_histogram(spark, d):
    return records.size_histogram(derived_observations(spark, d), ["place_id", "label_no"])


@query(f"{WITH} SELECT entry_id, count(DISTINCT label) AS n_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM obs GROUP BY entry_id HAVING count(DISTINCT label) > 1")
def label_jitter(spark, d):
    return records.label_jitter(derived_observations(spark, d), ["entry_id"])


@query("SELECT page_id, url AS value FROM pages UNION SELECT page_id, 'p' || page_id || '.png' FROM pages UNION SELECT page_id, 'q\"' || page_id % 7 FROM pages WHERE page_id % 2 = 0")
def json_file_names(spark, d):
    deep = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('q"'), F.col("page_id") % 7))
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.to_json(F.struct(
        F.col("url").alias("file_name"), F.lit('"file_name": "not a key"').alias("note"),
        F.array(F.struct(F.concat(F.lit("p"), "page_id", F.lit(".png")).alias("file_name"), F.struct(deep.alias("file_name"), F.lit(3).alias("n")).alias("more"))).alias("parts"),
    )).alias("doc"))
    return records.file_names(pages, "page_id", "doc")


@query(f"{WITH} SELECT object_global_id, 'feature=f' || object_global_id || ';type=' || label || ';lat=' || laterality || ';dist=' || distance_bin || ';vert=' || verticality || ';support=unknown;dcam=' || CASE WHEN distance_m IS NULL THEN 'na' ELSE printf('%.2f', distance_m) END || ';bearing=' || printf('%.1f', bearing_deg) || ';gx=' || {_HALF.format('x')} || ';gz=' || {_HALF.format('z')} || ';attrs=none;ctx=none;text=;desc=' || description AS line FROM obs")
def canonical_lines(spark, d):
    o = derived_observations(spark, d)
    none = F.expr("cast(array() as array<struct<label:string,distance_from_primary_m:double,relation_to_primary:string,estimated_global_x:double,estimated_global_z:double>>)")
    line = texts.canonical_line(F.concat(F.lit("f"), "object_global_id"), F.col("label"), F.col("laterality"), F.col("distance_bin"), F.col("verticality"), F.lit("unknown"), F.col("distance_m"), F.col("bearing_deg"), F.col("x"), F.col("z"), F.array().cast("array<string>"), none, F.lit(""), F.col("description"))
    return o.select("object_global_id", line.alias("line"))


# whole scenes


@query(f"{GRAPH}, c AS (SELECT 'places' AS \"check\", '' AS status, count(*) AS n FROM places UNION ALL SELECT 'views', '', count(*) FROM vp UNION ALL SELECT 'objects', '', count(*) FROM po UNION ALL SELECT 'same_node', '', (SELECT count(*) FROM vp WHERE place_id = '{SOME_PLACE}') + (SELECT count(*) FROM po WHERE place_id = '{SOME_PLACE}') UNION ALL SELECT 'place_objects', '', count(*) FROM po WHERE place_id = '{SOME_PLACE}' UNION ALL SELECT 'places_for_object', '', count(DISTINCT place_id) FROM po WHERE label = 'clock' UNION ALL SELECT 'direction_objects', '', count(*) FROM edges JOIN po ON po.place_id = target WHERE source = '{SOME_PLACE}' AND direction = 'NORTH_OF') SELECT \"check\", CASE WHEN n > 0 THEN 'passed' ELSE 'failed' END AS status, n FROM c")
def graph_checks(spark, d):
    return scene.graph_checks(scene.build(derived_views(spark, d), derived_observations(spark, d)), SOME_PLACE, "clock")


@query(f"{WITH} SELECT (SELECT count(*) FROM views) AS views, count(*) AS objects, count(gx) AS located, count(DISTINCT label) AS labels, count(DISTINCT entry_id) AS views_with_objects, round(count(*) / (SELECT count(*) FROM views)::DOUBLE, 6) AS objects_per_view FROM obs")
def build_report(spark, d):
    return scene.build_report(derived_views(spark, d), derived_observations(spark, d)).withColumn("objects_per_view", F.round("objects_per_view", 6))


@query(f"{WITH} SELECT object_global_id, ((orientation + CASE laterality WHEN 'left' THEN -30 WHEN 'right' THEN 30 ELSE 0 END) % 360 + 360) % 360::DOUBLE AS object_orientation_deg, '[' || laterality || '] ' || description AS text_long FROM obs")
def oriented_objects(spark, d):
    return scene.oriented(derived_observations(spark, d), 30.0, True).select("object_global_id", "object_orientation_deg", "text_long")


@query(f"""{WITH}, p AS (SELECT DISTINCT place_no AS anchor_id, x, z FROM obs), q AS (SELECT anchor_id, side, x + dx * (anchor_id % 3) AS x, z + dz * (anchor_id % 3) AS z, (anchor_id % 4) / 4::DOUBLE AS snap FROM p, (VALUES ('north', 0, -1), ('east', 1, 0), ('south', 0, 1), ('west', -1, 0)) t(side, dx, dz) WHERE NOT (anchor_id = 5 AND side = 'west'))
SELECT anchor_id, CASE WHEN count(*) <> 4 THEN 'wrong number of poses' WHEN max(snap) > 0.6 THEN 'moved too far' WHEN anchor_id % 3 = 0 THEN 'poses too close' END AS problem FROM q GROUP BY anchor_id""")
def pose_problems(spark, d):
    at = derived_observations(spark, d).select(F.col("place_no").alias("anchor_id"), "x", "z").distinct()
    poses = upkeep.anchor_poses(at, 1.0).join(at.select("anchor_id", F.col("x").alias("ax"), F.col("z").alias("az")), "anchor_id")
    reach = F.col("anchor_id") % 3
    moved = poses.select("anchor_id", "side", (F.col("ax") + (F.col("x") - F.col("ax")) * reach).alias("x"), (F.col("az") + (F.col("z") - F.col("az")) * reach).alias("z"), ((F.col("anchor_id") % 4) / 4).alias("snap_m"))
    return scene.valid_poses(moved.where("not (anchor_id = 5 and side = 'west')"), 0.6)


@query(f"""{ROOMS}, si AS (SELECT *, 'simple' AS kind FROM rooms WHERE num_objects >= 3 ORDER BY unique_label_ratio DESC, duplicate_objects, num_unique_labels DESC, room_function, view_type, room_id LIMIT 1),
co AS (SELECT *, 'complex' AS kind FROM rooms WHERE num_objects >= 3 AND duplicate_objects > 0 AND room_id NOT IN (SELECT room_id FROM si) ORDER BY duplicate_objects DESC, max_label_count DESC, num_objects DESC, room_function, view_type, room_id LIMIT 1),
ch AS (SELECT ro.*, room_id, kind FROM ro JOIN (SELECT * FROM si UNION ALL SELECT * FROM co) USING (room_function, view_type)),
cn AS (SELECT *, count(*) OVER (PARTITION BY room_id, label) AS n, row_number() OVER (PARTITION BY room_id, label ORDER BY entry_id, object_global_id) AS k FROM ch),
pk AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY CASE WHEN kind = 'simple' THEN CASE WHEN n = 1 THEN 0 ELSE 1 END WHEN n > 1 AND k <= 2 THEN 0 WHEN n = 1 THEN 1 ELSE 2 END, CASE WHEN kind = 'complex' AND n > 1 THEN -n ELSE 0 END, label, k) AS pick FROM cn WHERE kind = 'complex' OR k = 1),
sa AS (SELECT * FROM pk WHERE pick <= 8), sp AS (SELECT a.room_id, a.object_global_id AS i, b.object_global_id AS j, a.view_id = b.view_id AS sv,
  greatest(-1, least(1, list_inner_product(a.vec, b.vec) / (sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec))))) AS sim, exp(-(power(b.gx - a.gx, 2) + power(b.gy - a.gy, 2) + power(b.gz - a.gz, 2)) / 6.25) AS geometry
  FROM sa a JOIN sa b ON a.room_id = b.room_id AND a.object_global_id < b.object_global_id), sf AS (SELECT *, CASE WHEN geometry IS NOT NULL THEN 0.7 * sim + 0.3 * geometry ELSE sim END AS fused FROM sp)
SELECT room_id, i, j, round(sim, 6) AS sim, round(geometry, 6) AS geometry, round(fused, 6) AS fused, round(CASE WHEN sv THEN fused * 0.8 ELSE fused END, 6) AS fused_after FROM sf""")
def room_analysis_pairs(spark, d):
    t = scene.build(derived_views(spark, d), derived_observations(spark, d))
    return scene.analyse_rooms(t)["pairs"].select("room_id", "i", "j", _r("sim"), _r("geometry"), _r("fused"), _r("fused_after"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
