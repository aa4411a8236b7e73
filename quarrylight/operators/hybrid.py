"""Keyword scores (Okapi BM25) and their fusion with dense scores.

Okapi's usual constants: k1 1.5, b 0.75; a term in more than half of all documents has a negative idf and gets 0.25
times the mean idf of all terms instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import words_for_ranking

K1, B, FLOOR = 1.5, 0.75, 0.25
# Weights of dense score, detector confidence and BM25; least scores of the two methods.
W_DENSE, W_CONFIDENCE, W_KEYWORD = 0.55, 0.15, 0.30
LEAST_COSINE, LEAST_COMBINED = 0.15, 0.25


def term_statistics(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (id, term, tf, length) and terms (term, idf) of (id, text)."""
    words = docs.select("id", F.explode(words_for_ranking(F.col("text"))).alias("term")).where("term <> ''")
    tf = words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    lengths = docs.select("id", F.size(F.filter(words_for_ranking(F.col("text")), lambda w: w != "")).alias("length"))
    whole = docs.agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.crossJoin(F.broadcast(whole)).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return tf.join(lengths, "id"), idf


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, bm25) of documents that share a term with a query (query_id, text)."""
    postings, idf = term_statistics(docs)
    mean = docs.select(F.avg(F.size(F.filter(words_for_ranking(F.col("text")), lambda w: w != ""))).alias("mean_length"))
    asked = queries.select("query_id", F.explode(words_for_ranking(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    hit = asked.join(idf, "term").join(postings, "term").crossJoin(F.broadcast(mean))
    weight = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return hit.groupBy("query_id", "id").agg(F.sum(weight).alias("bm25"))


def hybrid(dense: DataFrame, keyword: DataFrame, least: float = LEAST_COMBINED) -> DataFrame:
    """Dense (query_id, id, score, confidence) and BM25 over its query's maximum, fused; low ones are left out."""
    peak = keyword.groupBy("query_id").agg(F.max("bm25").alias("peak"))
    scaled = keyword.join(peak, "query_id").select("query_id", "id", F.when(F.col("peak") > 0, F.col("bm25") / F.col("peak")).otherwise(F.col("bm25")).alias("keyword"))
    both = dense.join(scaled, ["query_id", "id"], "left").withColumn("keyword", F.coalesce("keyword", F.lit(0.0)))
    return both.withColumn("combined", W_DENSE * F.col("score") + W_CONFIDENCE * F.coalesce("confidence", F.lit(0.0)) + W_KEYWORD * F.col("keyword")).where(F.col("combined") >= least)


def best_of_queries(scored: DataFrame, entity: list[str]) -> DataFrame:
    """Over expanded queries: the highest score of each entity, with the query that gave it."""
    return scored.groupBy(*entity).agg(F.max_by(F.struct(*[c for c in scored.columns if c not in entity]), F.struct("combined", F.col("query_id") * -1)).alias("_r")).select(*entity, "_r.*")
