"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import quality, toxicity
from .annindex import nearest
from .common import table
from .exact import exact_dedup
from .kdshard import kd_shards
from .minhash import near_duplicates
from .mixing import mix_sources
from .packing import pack
from .runindex import remove_repeats
from .toolchat import TURN_SCHEMAS, link_tool_calls, turns_as_calls


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = turns_as_calls(table(spark, sf_dir, "conversations"))
    linked = link_tool_calls(calls, results, TURN_SCHEMAS)
    return linked.select(
        F.col("conv").alias("conv_id"), "call_id", F.col("seq").alias("turn"), F.col("result_seq").alias("result_turn"), "name", "n_calls", "n_results",
        "status", F.concat_ws(",", "errors").alias("errors"), "missing_deps", "cyclic", F.col("topo_order").cast("long").alias("topo_order"), "message",
    )


#: Faults and dependencies follow from the bytes of a turn's text, see ``turns_as_calls``.
OP1_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id AS conv, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
calls AS (
  SELECT conv, conv || ':' || turn AS id, turn, 'reply' AS name, '{"prompt":' || to_json(text) || ',"turn":' || turn || '}' AS canonical, '' AS errors,
    CASE WHEN EXISTS (SELECT 1 FROM t p WHERE p.conv = t.conv AND p.turn = t.turn - 2 AND p.role = 'user')
      AND EXISTS (SELECT 1 FROM t p WHERE p.conv = t.conv AND p.turn = t.turn - 1 AND p.role = 'assistant') THEN conv || ':' || (turn - 2) END AS dep
  FROM t WHERE role = 'user'
  UNION ALL
  SELECT conv, conv || ':' || turn || ':note', turn, CASE WHEN n % 7 = 0 THEN 'memo' ELSE 'note' END,
    CASE n % 5 WHEN 1 THEN '{"text":' || to_json(text) || '}' WHEN 2 THEN '{"text":' || to_json(text) || ',"turn":"' || turn || '"}'
      WHEN 3 THEN '[' || turn || ']' ELSE '{"text":' || to_json(text) || ',"turn":' || turn || '}' END,
    CASE WHEN n % 5 = 3 THEN 'not_an_object' WHEN n % 7 = 0 THEN 'unknown_tool' WHEN n % 5 = 1 THEN 'missing:turn' WHEN n % 5 = 2 THEN 'type:turn' ELSE '' END,
    CASE n % 3 WHEN 0 THEN conv || ':' || (turn + 2) || ':note' WHEN 1 THEN conv || ':' || (turn - 2) || ':note' END
  FROM t WHERE role = 'assistant'
  UNION ALL
  SELECT conv, conv || ':' || turn || ':' || coalesce(role, ''), turn, role, '{"text":' || to_json(text) || '}', CASE WHEN role = 'system' THEN '' ELSE 'unknown_tool' END, NULL
  FROM t WHERE role IS NULL OR role NOT IN ('user', 'assistant')),
c AS (SELECT conv, id, min(turn) AS turn, min(name) AS name, min(canonical) AS canonical, min(errors) AS errors, min(dep) AS dep, count(*) AS n FROM calls GROUP BY 1, 2),
r AS (
  SELECT conv, id, min(turn) AS turn, min(text) AS text, count(*) AS n FROM (
    SELECT conv, conv || ':' || (turn - 1) AS id, turn, text FROM t WHERE role = 'assistant'
    UNION ALL SELECT conv, conv || ':' || (turn - 1) || ':note', turn, text FROM t WHERE role = 'user' AND turn > 0) GROUP BY 1, 2),
e AS (SELECT c.conv, c.id, c.dep, c.turn, d.turn AS dep_turn FROM c JOIN c d ON d.conv = c.conv AND d.id = c.dep),
late AS (SELECT conv, id FROM e WHERE dep_turn >= turn UNION SELECT e.conv, e.id FROM e JOIN late ON late.conv = e.conv AND late.id = e.dep),
placed AS (
  SELECT conv, id, 1 AS round FROM late WHERE NOT EXISTS (SELECT 1 FROM e JOIN late l ON l.conv = e.conv AND l.id = e.dep WHERE e.conv = late.conv AND e.id = late.id)
  UNION ALL SELECT e.conv, e.id, round + 1 FROM placed JOIN e ON e.conv = placed.conv AND e.dep = placed.id),
o AS (
  SELECT c.conv, c.id, late.id IS NOT NULL AND round IS NULL AS cyclic,
    row_number() OVER (PARTITION BY c.conv ORDER BY late.id IS NOT NULL AND round IS NULL, coalesce(round, 0), c.turn, c.id) AS topo_order
  FROM c LEFT JOIN late ON late.conv = c.conv AND late.id = c.id LEFT JOIN placed ON placed.conv = c.conv AND placed.id = c.id)
SELECT conv AS conv_id, id AS call_id, c.turn AS turn, r.turn AS result_turn, name, coalesce(c.n, 0) AS n_calls, coalesce(r.n, 0) AS n_results,
  CASE WHEN c.n IS NULL THEN 'orphan_result' WHEN r.n IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  coalesce(errors, '') AS errors, CASE WHEN c.dep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c d WHERE d.conv = c.conv AND d.id = c.dep) THEN 1 ELSE 0 END AS missing_deps,
  coalesce(cyclic, false) AS cyclic, topo_order,
  '{"arguments":' || coalesce(canonical, 'null') || ',"id":' || to_json(id) || ',"name":' || coalesce(to_json(name), 'null')
  || ',"result":' || CASE WHEN r.n IS NULL THEN 'null' ELSE CAST(to_json(r.text) AS VARCHAR) END || '}' AS message
FROM c FULL JOIN r USING (conv, id) LEFT JOIN o USING (conv, id)
"""


def op2_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_pruned_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op5_minhash_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op6_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_dedup(docs)
    return found.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def op7_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: The excess over the caps is reshared in closed form: sources are capped in the order of size for weight.
OP9_SQL = """
WITH d AS (
  SELECT doc_id, source IS NULL AS missing, coalesce(source, '') AS name,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size
  FROM documents),
p AS (
  SELECT *, length(bin(size + 1)) * 8 + (((size + 1) * 8) >> (length(bin(size + 1)) - 1)) - 8 AS class,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS digest FROM d),
s AS (SELECT missing, name, sum(size)::BIGINT AS source_size FROM p GROUP BY ALL),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY missing, name) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - 2 * coalesce(sum(source_size) OVER b, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY source_size / w, missing, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, row(source_size / w, missing, name)) AS final FROM l WHERE level * w < 2 * source_size),
g AS (SELECT missing, name, source_size, CASE WHEN level * w >= 2 * source_size THEN 2.0::DOUBLE * source_size ELSE final * w END AS target FROM l, f),
r AS (
  SELECT doc_id, size, source_size, target, row_number() OVER (PARTITION BY missing, name ORDER BY class, digest, size, doc_id NULLS FIRST) AS k,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1' || name || missing::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM p JOIN g USING (missing, name)),
c AS (SELECT *, (floor(k * rate + u) - floor((k - 1) * rate + u))::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_tool_call_linking, op2_run_length_index, op3_kd_tree_shards, op4_pruned_graph_search, op5_minhash_inverted_join, op6_content_sort_dedup, op7_quality_gbt, op8_toxicity_counterfactual, op9_systematic_mix, op10_lexical_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_tool_call_linking": OP1_SQL, "op6_content_sort_dedup": OP6_SQL, "op9_systematic_mix": OP9_SQL}
