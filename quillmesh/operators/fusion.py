"""Rank fusion, lexical rerank and the registry of retrievers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import tokens
from quillmesh.operators.lexical import DIGITS, parted, ranked

RRF_K, LEG_K, FETCH_K = 60, 10, 20


def reciprocal_ranks(*lists: DataFrame, k: int = 5, rrf_k: int = RRF_K, leg_k: int = LEG_K) -> DataFrame:
    """(query_id, chunk_id, score, rank, candidate_count) of ranked lists (query_id, chunk_id, rank), each cut at ``leg_k``.
    candidate_count is the number of different chunks in the cut lists."""
    legs = [d.where(F.col("rank") <= leg_k).select("query_id", "chunk_id", "rank") for d in lists]
    both = legs[0]
    for d in legs[1:]:
        both = both.unionByName(d)
    fused = both.where(F.col("query_id").isNotNull()).groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"))
    counts = F.count("*").over(Window.partitionBy("query_id")).alias("candidate_count")
    return ranked(fused.select("*", counts), k).select("query_id", "chunk_id", "score", "rank", "candidate_count")


def rerank(hits: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 5, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(query_id, chunk_id, score, rank): base score, share of the query's terms in the text and in the headings, weighted. Queries
    without terms keep their hits unchanged and uncut. ``chunks`` have their text (index_text) or its terms as an index has them (words)."""
    if any(w < 0 or w != w or w == float("inf") for w in weights):
        raise ValueError("weights must be finite and not negative")
    q = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("q"))
    text = "words" if "words" in chunks.columns else "index_text"
    at = hits.select("query_id", "chunk_id", F.col("score").alias("base"), F.col("rank").alias("base_rank")).join(q, "query_id").join(chunks.select("chunk_id", "heading_path", text), "chunk_id")
    c, h = F.array_distinct(parted(text) if text == "words" else tokens(F.col(text))), F.array_distinct(tokens(F.array_join("heading_path", " ")))  # only hits' texts are cut into terms
    n = F.size("q")
    score = weights[0] * F.col("base") + weights[1] * F.size(F.array_intersect("q", c)) / n + weights[2] * F.size(F.array_intersect("q", h)) / n
    every = at.select("query_id", "chunk_id", "base_rank", (n > 0).alias("has"), F.when(n > 0, score).otherwise(F.col("base")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "chunk_id")
    placed = every.withColumn("rank", F.row_number().over(order).cast("bigint")).where(~F.col("has") | (F.col("rank") <= k))  # one pass, so that the hits are searched for once
    return placed.select("query_id", "chunk_id", "score", F.when(F.col("has"), F.col("rank")).otherwise(F.col("base_rank")).alias("rank"))
