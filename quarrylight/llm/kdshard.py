"""Shards as the leaves of a k-d tree (DataFrame functions only).

Every leaf of the tree is a shard with room for the same number of bytes. The tree splits a node at the weighted quantile
that its lower half of shards has of the room of all its shards, along its widest metadata dimension, until every node
is one shard; weights are bytes, so shards get nearly equal bytes. The dimensions are the logarithm of the size, the
source, the language and the document id (names by their CRC32); the width of a dimension is its range in the node over
its range in the table.

Equal texts are one point of the tree, with the smallest source, language and identifier of the group, and so stay in
one shard. A group of more than 1 / ``ATOM`` of a shard is too coarse a point for a quantile: those (there are at most
``shards * ATOM``) are dealt to shards first, largest first to the emptiest shard, and the tree has the room that is
left. Of a group only what does not fit into a shard is split.

Quantiles are searched by histograms of at most ``BINS`` bins a node: the driver receives bin weights only, whose number
does not grow with the data, and narrows each node's range until one bin holds less than ``TOLERANCE`` of a shard. Ties
on a dimension are broken by a digest of the text that fills the lower half of the split key.

Defined results: a null text has 0 bytes and the CRC of an empty one; null metadata counts as an empty name, a null
identifier as the smallest; repeated rows are rows of their own; with fewer points than shards some shards stay empty;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, empty_like, materialise, running_rank, spread, utf8

SHARDS = 40
#: Bytes that a document takes besides its text.
ROW_BYTES = 16
ATOM = 16
BINS = 2048
TOLERANCE = 0.002
PARTS = 256
DIMS = ("size", "source", "lang", "id")
#: Values of a dimension have 30 bits, so that the end of a range of split keys still is a long.
FULL = 2**30 - 1


def _pick(values: list[int], index):
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), (index + 1).cast("int"))


def _deal(groups: list[tuple[int, int]], shards: int, leaf: float) -> tuple[list[float], list[list[tuple[int, int, int]]]]:
    """Room left in each shard, and for each group (rows, bytes of a row), largest first, its (shard, after row, to row)."""
    room, dealt = [leaf] * shards, []
    for rows, size in groups:
        at, pieces = 0, []
        while at < rows:
            shard = max(range(shards), key=lambda i: (room[i], -i))
            fit = rows - at if (rows - at) * size <= room[shard] + TOLERANCE * leaf else min(rows - at, max(1, round(room[shard] / size)))
            pieces.append((shard, at, at + fit))
            room[shard] = max(0.0, room[shard] - size * fit)
            at += fit
        dealt.append(pieces)
    return room, dealt


def _split_points(points: DataFrame, nodes: list[dict], leaf_bytes: float) -> None:
    """Adds to each node that is still to be split its ``cut``: keys from it on go right."""
    for n in nodes:
        n["open"] = n["k"] > 1
        if n["open"]:
            n |= {"lo": n["min"][n["dim"]] << 32, "hi": (n["max"][n["dim"]] + 1) << 32, "under": 0, "goal": n["weight"] * sum(n["room"][: n["k"] // 2]) / max(1e-9, sum(n["room"]))}
    key = F.element_at(F.array(*(F.col(f"key_{d}") for d in DIMS)), (_pick([n.get("dim", 0) for n in nodes], F.col("node")) + 1).cast("int"))
    while any(n["open"] for n in nodes):
        for n in nodes:
            if n["open"]:
                n["step"] = max(1, -(-(n["hi"] - n["lo"]) // BINS))
        low, step = (_pick([n.get(x, 1) if n["open"] else 1 for n in nodes], F.col("node")) for x in ("lo", "step"))
        high = _pick([n["hi"] if n["open"] else 0 for n in nodes], F.col("node"))
        bins = (
            points.select("node", "weight", key.alias("key"))
            .where((F.col("key") >= low) & (F.col("key") < high))
            .groupBy("node", F.floor((F.col("key") - low) / step).cast("long").alias("bin"))
            .agg(F.sum("weight").alias("w"), F.min("key").alias("least"), F.max("key").alias("most"))
            .collect()
        )
        found: dict[int, list] = {}
        for b in bins:
            found.setdefault(b["node"], []).append((b["bin"], b["w"], b["least"], b["most"]))
        for i, n in enumerate(nodes):
            if not n["open"]:
                continue
            at = n["under"]
            for _, w, least, most in sorted(found.get(i, [])):
                if at + w >= n["goal"]:
                    if least == most or w <= TOLERANCE * leaf_bytes:
                        n["open"], n["cut"] = False, least if n["goal"] - at < at + w - n["goal"] else most + 1
                    else:
                        n |= {"under": at, "lo": least, "hi": most + 1}
                    break
                at += w
            else:
                n["open"], n["cut"] = False, n["hi"]


def kd_shards(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``shard``, ``slot`` (from 0 within the shard)."""
    spark, text = docs.sparkSession, clean_text(docs[text_col])
    rows = materialise(
        docs.select(
            docs[id_col].cast("long").alias("_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(utf8(text)).alias("text_crc32"),
            F.xxhash64(text).alias("digest"),
            F.crc32(F.coalesce(docs[source_col].cast("string"), F.lit("")).cast("binary")).alias("source"),
            F.crc32(F.coalesce(docs[lang_col].cast("string"), F.lit("")).cast("binary")).alias("lang"),
        ),
        "kd-rows",
    )
    whole = rows.agg(F.sum("size"), F.min("_id"), F.max("_id")).first()
    total, first, last = whole[0] or 0, whole[1] or 0, whole[2] or 0
    if not total:
        return empty_like(spark, f"{id_col} long, size long, text_crc32 long, shard int, slot long")
    leaf = total / shards

    text_key = ["digest", "text_crc32", "size"]
    large = rows.groupBy(*text_key).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > leaf / ATOM).orderBy(F.desc("bytes"), *text_key).collect()
    # at most shards * ATOM rows
    room, dealt = _deal([(r["bytes"] // r["size"], r["size"]) for r in large], shards, leaf)
    table = [(r["digest"], r["text_crc32"], r["size"], shard, after, to, len(pieces)) for r, pieces in zip(large, dealt) for shard, after, to in pieces]
    places = F.broadcast(spark.createDataFrame(table, "digest long, text_crc32 long, size long, to_shard int, after long, to long, pieces int"))
    whole_groups, cut_groups = places.where("pieces = 1"), places.where("pieces > 1")
    columns = ["_id", "size", "text_crc32", F.col("to_shard").alias("shard")]
    fixed = rows.join(whole_groups, text_key).select(*columns)
    if any(len(pieces) > 1 for pieces in dealt):
        cut = materialise(rows.join(cut_groups.select(*text_key).distinct(), text_key, "left_semi").withColumn("part", spread(F.col("_id"), PARTS)), "kd-cut")
        counted = running_rank(cut, text_key, "part", [F.col("_id").asc_nulls_first()], "row")
        fixed = fixed.unionByName(counted.join(cut_groups, text_key).where("row > after and row <= to").select(*columns))
    pieced = rows.join(places, text_key, "left_anti")
    tie = F.shiftrightunsigned(F.xxhash64("digest"), 32)
    span = max(1, last - first)
    value = {
        "size": F.floor(F.log2(F.col("size").cast("double")) * 2.0**23).cast("long"),
        "source": F.shiftright(F.col("source"), 2),
        "lang": F.shiftright(F.col("lang"), 2),
        "id": F.floor((F.coalesce(F.col("_id"), F.lit(first)) - first) / F.lit(float(span)) * FULL).cast("long"),
    }
    points = materialise(
        pieced.groupBy(*text_key)
        .agg(F.sum("size").alias("weight"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("_id").alias("_id"))
        .select(*text_key, "weight", *((F.shiftleft(value[d], 32) + tie).alias(f"key_{d}") for d in DIMS)),
        "kd-points",
    )
    placed, nodes, width = points.withColumn("node", F.lit(0).cast("long")), [{"k": shards, "room": room}], None
    while any(n["k"] > 1 for n in nodes):
        ranges = [f(F.shiftright(f"key_{d}", 32)).alias(f"{f.__name__}_{d}") for f in (F.min, F.max) for d in DIMS]
        for r in placed.groupBy("node").agg(F.sum("weight").alias("weight"), *ranges).collect():
            nodes[r["node"]] |= {"weight": r["weight"], "min": [r[f"min_{d}"] for d in DIMS], "max": [r[f"max_{d}"] for d in DIMS]}
        width = width or [max(1, b - a) for a, b in zip(nodes[0]["min"], nodes[0]["max"], strict=True)]
        for n in nodes:
            n.setdefault("weight", 0)
            n.setdefault("min", [0] * len(DIMS))
            n.setdefault("max", [0] * len(DIMS))
            n["dim"] = max(range(len(DIMS)), key=lambda d: ((n["max"][d] - n["min"][d]) / width[d], -d))  # noqa: B023
        _split_points(placed, nodes, leaf)
        below, left, right = [], [], []
        for n in nodes:
            left.append(len(below))
            half = n["k"] // 2
            below.append({"k": half or 1, "room": n["room"][: half or 1]})
            if n["k"] > 1:
                below.append({"k": n["k"] - half, "room": n["room"][half:]})
            right.append(len(below) - 1)
        key = F.element_at(F.array(*(F.col(f"key_{d}") for d in DIMS)), (_pick([n["dim"] for n in nodes], F.col("node")) + 1).cast("int"))
        goes_right = key >= _pick([n.get("cut", 0) for n in nodes], F.col("node"))
        placed = materialise(placed.withColumn("node", F.when(goes_right, _pick(right, F.col("node"))).otherwise(_pick(left, F.col("node")))), "kd-level")
        nodes = below

    leaves = placed.select(*text_key, F.col("node").cast("int").alias("shard"))
    sharded = materialise(
        pieced.join(leaves, text_key).select("_id", "size", "text_crc32", "shard").unionByName(fixed).withColumn("part", spread(F.col("_id"), PARTS)),
        "kd-shards",
    )
    ranked = running_rank(sharded, ["shard"], "part", [F.col("_id").asc_nulls_first(), "text_crc32"], "rank")
    return ranked.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("rank") - 1).alias("slot"))
