"""The audit of a baseline: what a reader of a normalized book should look at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import is_blank, trimmed

#: Outlines of headings, the length of short ones, and the marks that end a text.
HEADING_OUTLINE = r"^(?:\d+(?:\.\d+){1,3}\s|第[一二三四五六七八九十百千0-9]+[章节篇部分])"
SHORT = 24
ENDS = ("。", "；", "，", "！", "？", ".", ";", ",")


def heading_candidates(blocks: DataFrame) -> DataFrame:
    """Paragraphs and list items that look like headings: an outline number, or short and without a mark at the end (FIL13)."""
    t = trimmed(F.col("text"))
    body = F.col("block_type").isin("paragraph", "list_item") & ~is_blank(F.col("text"))
    return blocks.where(body & (t.rlike(f"(?U){HEADING_OUTLINE}") | ((F.char_length(t) <= SHORT) & ~F.substring(t, -1, 1).isin(*ENDS))))


def page_context(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, page, context): the heading path of the first block on each page (document_id, page) to be reviewed."""
    first = blocks.groupBy("document_id", F.col("page_start").alias("page")).agg(F.min_by(F.coalesce("heading_path", F.array().cast("array<string>")), F.struct("ordinal", "block_id")).alias("p"))
    return pages.join(first, ["document_id", "page"], "left").select("document_id", "page", F.array_join("p", " / ").alias("context"))


def unregistered(files: DataFrame, known: DataFrame) -> DataFrame:
    """File names (path) that no known path has (SET7)."""

    def names(df: DataFrame) -> DataFrame:
        return df.where("path is not null").select(F.element_at(F.split("path", "[/\\\\]"), -1).alias("name")).distinct()

    return names(files).join(names(known), "name", "left_anti")


def overview(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, blocks, headings, captions, candidates, review_pages) for the report (SNK16)."""
    kind = F.col("block_type")
    counts = blocks.groupBy("document_id").agg(F.count("*").alias("blocks"), F.count_if(kind.isin("document_title", "section_heading")).alias("headings"), F.count_if(kind == "figure_caption").alias("captions"))
    found = heading_candidates(blocks).groupBy("document_id").agg(F.count("*").alias("candidates"))
    review = pages.groupBy("document_id").agg(F.count_distinct("page").alias("review_pages"))
    out = counts.join(found, "document_id", "left").join(review, "document_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("candidates", "review_pages")})
