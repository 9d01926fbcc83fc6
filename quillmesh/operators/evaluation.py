"""Retrieval metrics over labelled queries, and the cases themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import is_blank, slug, trimmed
from quillmesh.sources.tables import once


def case_results(cases: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """(case_id, first_relevant_rank, hit_at_k, recall_at_k, reciprocal_rank) of every case (case_id, relevant_chunk_ids); a case
    without hits or relevant ids counts as a miss."""
    relevant = cases.select("case_id", F.array_distinct("relevant_chunk_ids").alias("ids"))
    pairs = relevant.select("case_id", F.explode("ids").alias("chunk_id"))
    found = pairs.join(hits.where(F.col("rank") <= k).select(F.col("query_id").alias("case_id"), "chunk_id", "rank"), ["case_id", "chunk_id"])
    by = found.groupBy("case_id").agg(F.min("rank").alias("first_relevant_rank"), F.count_distinct("chunk_id").alias("n"))
    out = relevant.join(by, "case_id", "left")
    size = F.greatest(F.size("ids"), F.lit(1))
    return out.select("case_id", "first_relevant_rank", F.col("n").isNotNull().alias("hit_at_k"), (F.coalesce("n", F.lit(0)) / size).alias("recall_at_k"), F.coalesce(1.0 / F.col("first_relevant_rank"), F.lit(0.0)).alias("reciprocal_rank"))


def report(results: DataFrame) -> DataFrame:
    """One row: case_count, hit_rate_at_k, mean_recall_at_k, mrr."""
    return results.agg(F.count("*").alias("case_count"), F.avg(F.col("hit_at_k").cast("double")).alias("hit_rate_at_k"), F.avg("recall_at_k").alias("mean_recall_at_k"), F.avg("reciprocal_rank").alias("mrr"))


def unknown_relevant(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, chunk_id): relevant ids that no chunk has."""
    return cases.select("case_id", F.explode("relevant_chunk_ids").alias("chunk_id")).distinct().join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("case_id", "chunk_id")


def known_only(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cases with only those relevant ids that exist, cases left without any dropped."""
    kept = cases.select("case_id", F.posexplode("relevant_chunk_ids").alias("i", "chunk_id")).join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    ids = kept.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "chunk_id"))), lambda x: x["chunk_id"]).alias("relevant_chunk_ids"))
    return cases.drop("relevant_chunk_ids").join(ids, "case_id")


def heading_cases(chunks: DataFrame, prefix: str = "section") -> DataFrame:
    """One case for each last heading: the query is the heading, relevant are the chunks under it in order."""
    under = chunks.where(F.size("heading_path") > 0).withColumn("heading", F.element_at("heading_path", -1))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("document_id", "ordinal", "chunk_id"))), lambda x: x["chunk_id"])
    return under.groupBy("heading").agg(ids.alias("relevant_chunk_ids")).select(F.concat_ws("-", F.lit(prefix), slug(F.col("heading"))).alias("case_id"), F.col("heading").alias("query"), "relevant_chunk_ids")


def relevant_under(probes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, case_id, chunk_id, place): for each probe (document_id, case_id, heading, text) the chunks of its document with the heading
    anywhere in their path that hold the text, if one is given, in order (FIL12, J18). Paths are exploded and joined by heading. One
    row for each chunk, as a heading may have any number of them."""
    under = chunks.select("document_id", "chunk_id", "ordinal", "content", F.explode(F.array_distinct("heading_path")).alias("heading"))
    asked = probes.where(~is_blank(F.col("heading"))).select("document_id", "case_id", "heading", "text")
    met = asked.join(under, ["document_id", "heading"]).where(F.col("text").isNull() | F.contains(F.coalesce("content", F.lit("")), "text"))
    place = F.row_number().over(Window.partitionBy("document_id", "case_id").orderBy("ordinal", "chunk_id"))
    return met.select("document_id", "case_id", "chunk_id", place.alias("place"))


def section_probes(blocks: DataFrame) -> DataFrame:
    """(document_id, case_id, heading, text): one probe for each section heading with text; the case id has its place and slug."""
    heading = trimmed(F.col("text"))
    rows = blocks.where((F.col("block_type") == "section_heading") & ~is_blank(F.col("text")))
    case = F.concat(F.lit("section-"), F.lpad(F.col("ordinal").cast("string"), 3, "0"), F.lit("-"), slug(heading))
    long = F.concat(F.lit("section-"), F.col("ordinal").cast("string"), F.lit("-"), slug(heading))
    return rows.select("document_id", F.when(F.col("ordinal") < 1000, case).otherwise(long).alias("case_id"), heading.alias("heading"), F.lit(None).cast("string").alias("text"))


def rebound(template: DataFrame, blocks: DataFrame) -> DataFrame:
    """Probes of a template's section cases (document_id, case_id, query) on new blocks: a heading that none of them has is an error when the
    rows are read."""
    have = section_probes(blocks).select("document_id", "heading", F.lit(True).alias("__k")).distinct()
    asked = template.where(F.col("case_id").startswith("section-")).select("document_id", "case_id", F.col("query").alias("heading"))
    at = asked.join(have, ["document_id", "heading"], "left")
    known = F.when(F.col("__k"), F.col("heading")).otherwise(F.raise_error(F.concat(F.lit("no such heading: "), "heading")))
    return at.select("document_id", "case_id", known.alias("heading"), F.lit(None).cast("string").alias("text"))


def merged(relevance: DataFrame, probes: DataFrame, *others: DataFrame) -> DataFrame:
    """Cases (case_id, relevant_chunk_ids) from relevance rows and from other tables of cases: a case id that comes twice is an error when the rows
    are read; probes without chunks have an empty list."""
    ids = relevance.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("relevant_chunk_ids"))
    nothing = F.array().cast("array<string>")
    rows = probes.select("case_id").join(ids, "case_id", "left").withColumn("relevant_chunk_ids", F.coalesce("relevant_chunk_ids", nothing))
    for o in others:
        rows = rows.unionByName(o.select("case_id", "relevant_chunk_ids"))
    by = rows.groupBy("case_id").agg(F.count("*").alias("n"), F.first("relevant_chunk_ids").alias("relevant_chunk_ids"))
    case = F.when(F.col("n") == 1, F.col("case_id")).otherwise(F.raise_error(F.concat(F.lit("the case id comes twice: "), "case_id")))
    return by.select(case.alias("case_id"), "relevant_chunk_ids")


def duplicate_cases(cases: DataFrame) -> DataFrame:
    return cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1")


def clean(cases: DataFrame) -> DataFrame:
    """Cases with a query, each once."""
    return once(cases.where("query is not null"), "case_id", order=None)
