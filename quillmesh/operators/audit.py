"""Quality audit of blocks and chunks: every rule is one filter or join that gives issue rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import ORPHANS, TERMINATORS, is_blank, trimmed, trimmed_right
from quillmesh.operators.sequences import own, stretched, within

#: Patterns of the rules.
FIGURE_LABEL = r"^(?:[A-Za-z]{1,3}|/|[）)]|[（(]?[a-zA-Z0-9][）)]?)$"
NUMBERED_PARAGRAPH = r"^(?:\d+(?:\.\d+)*[.、]?)\s+\S+$"
SUSPICIOUS_SPACING = r"(?:https?://|www\.|\b\w+\.)\s+[A-Za-z0-9]"
MARKER = "formula-not-decoded"


@dataclass(frozen=True)
class AuditConfig:
    max_chars: int = 1200
    short_ratio: float = 0.04
    review_ratio: float = 0.25


COLUMNS = ("issue_code", "severity", "pipeline_stage", "document_id", "page", "block_id", "block_ordinal", "chunk_id", "chunk_ordinal", "evidence")


def issue(rows: DataFrame, code: str, severity: str, stage: str, evidence: Column, block: bool = True) -> DataFrame:
    none = F.lit(None)
    return rows.select(
        F.lit(code).alias("issue_code"), F.lit(severity).alias("severity"), F.lit(stage).alias("pipeline_stage"), "document_id", F.col("page_start").alias("page"),
        (F.col("block_id") if block else none.cast("string")).alias("block_id"), (F.col("ordinal") if block else none.cast("bigint")).alias("block_ordinal"),
        (none.cast("string") if block else F.col("chunk_id")).alias("chunk_id"), (none.cast("bigint") if block else F.col("ordinal")).alias("chunk_ordinal"), evidence.cast("string").alias("evidence"),
    )


def bad_pages() -> Column:
    a, b = F.col("page_start"), F.col("page_end")
    return a.isNull() | b.isNull() | (a < 1) | (b < a)


def block_issues(blocks: DataFrame) -> DataFrame:
    """Rules Q5-Q7 and Q9-Q13 over blocks; a blank block has no other issue of its own."""
    text = F.col("text")
    clean, para = trimmed(text), F.col("block_type") == "paragraph"
    lone = clean.isin(*ORPHANS)
    some = blocks.where(~is_blank(text))
    rules = [
        issue(blocks.where(is_blank(text)), "EMPTY_BLOCK", "error", "normalization", F.lit("blank")),
        issue(some.where(F.col("block_type").isin("paragraph", "list_item") & lone), "ORPHAN_PUNCTUATION_BLOCK", "error", "normalization", clean),
        issue(some.where(bad_pages()), "INVALID_PAGE_RANGE", "error", "normalization", F.concat_ws("-", "page_start", "page_end")),
        issue(some.where(para & (F.char_length(clean) == 1) & ~lone), "VERY_SHORT_TEXT_BLOCK", "warning", "normalization", clean),
        issue(some.where(para & clean.rlike(f"(?U){NUMBERED_PARAGRAPH}")), "HEADING_LIKE_PARAGRAPH", "warning", "normalization", clean),
        issue(some.where(text.rlike(f"(?U){SUSPICIOUS_SPACING}")), "SUSPICIOUS_WORD_SPACING", "warning", "normalization", F.lit("spacing")),
        label_sequences(blocks),
        order_breaks(blocks),
    ]
    return reduce(DataFrame.unionByName, rules)


def label_sequences(blocks: DataFrame) -> DataFrame:
    """Q12: runs of two or more label-like rows on a page with a figure caption right before or after."""
    w = Window.partitionBy("document_id", "page_start").orderBy("ordinal", "block_id")
    label = F.coalesce(F.col("block_type").isin("paragraph", "list_item") & trimmed(F.col("text")).rlike(FIGURE_LABEL), F.lit(False))
    caption = F.coalesce(F.col("block_type") == "figure_caption", F.lit(False))
    at = blocks.where("page_start is not null").withColumn("__l", label).withColumn("__n", F.row_number().over(w))
    at = at.withColumn("__c", F.max(caption.cast("int")).over(w.rowsBetween(-1, 1)))
    at = at.where("__l").withColumn("__run", F.col("__n") - F.row_number().over(w))
    runs = at.groupBy("document_id", "page_start", "__run").agg(F.count("*").alias("n"), F.max("__c").alias("c"), F.min_by("block_id", F.struct("ordinal", "block_id")).alias("block_id"), F.min("ordinal").alias("ordinal"))
    return issue(runs.where("n >= 2 and c = 1"), "POSSIBLE_FIGURE_LABEL_SEQUENCE", "warning", "normalization", F.col("n"))


def order_breaks(blocks: DataFrame) -> DataFrame:
    """Q13: unfinished text followed on its page by lone punctuation."""
    w = within()
    nxt = trimmed(F.lead("text").over(w))
    test = (F.lead("page_start").over(w) == F.col("page_start")) & nxt.isin(*ORPHANS) & ~F.substring(trimmed_right(F.col("text")), -1, 1).isin(*TERMINATORS)
    rows = stretched(blocks.select("document_id", "block_id", "ordinal", "page_start", "text"))
    at = own(rows.withColumn("__t", F.coalesce(test, F.lit(False))).withColumn("__x", nxt))
    return issue(at.where("__t"), "POSSIBLE_READING_ORDER_BREAK", "warning", "normalization", F.col("__x"))


def missing_images(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Q8: image paths that are absolute, leave their folder or are in no file listing (path)."""
    has = blocks.where("image_path is not null")
    p = F.col("image_path")
    unsafe = p.startswith("/") | p.rlike(r"^[A-Za-z]:") | p.rlike(r"(^|/|\\)\.\.(/|\\|$)")
    known = files.select(F.col("path").alias("image_path")).distinct().withColumn("__f", F.lit(True))
    at = has.join(known, "image_path", "left")
    return issue(at.where(unsafe | F.col("__f").isNull()), "MISSING_IMAGE_TARGET", "error", "normalization", p)


def chunk_issues(chunks: DataFrame, blocks: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    """Rules Q17-Q20 over chunks."""
    ids = chunks.select("chunk_id", "document_id", "page_start", "ordinal", F.explode("block_ids").alias("__b"))
    unknown = ids.join(blocks.select(F.col("block_id").alias("__b")).distinct(), "__b", "left_anti").select("chunk_id", "document_id", "page_start", "ordinal").distinct()
    twice = chunks.where(F.size("block_ids") != F.size(F.array_distinct("block_ids"))).select("chunk_id", "document_id", "page_start", "ordinal")
    rules = [
        issue(chunks.where(is_blank(F.col("content")) | is_blank(F.col("index_text"))), "EMPTY_CHUNK", "error", "chunking", F.lit("blank"), block=False),
        issue(chunks.where(bad_pages()), "INVALID_PAGE_RANGE", "error", "chunking", F.concat_ws("-", "page_start", "page_end"), block=False),
        issue(chunks.where(F.char_length("index_text") > config.max_chars), "CHUNK_EXCEEDS_CONFIGURED_LIMIT", "error", "chunking", F.char_length("index_text"), block=False),
        issue(unknown.unionByName(twice).distinct(), "BROKEN_BLOCK_REFERENCE", "error", "chunking", F.lit("reference"), block=False),
    ]
    return reduce(DataFrame.unionByName, rules)


def count_mismatch(rows: DataFrame, reported: int, stage: str, name: str) -> DataFrame:
    """Q4, Q16: one issue if a report's count isn't the rows' (AGG18)."""
    n = rows.agg(F.count("*").alias("n")).where(F.col("n") != reported)
    found = n.select(*[F.lit(None).cast(t).alias(c) for c, t in (("document_id", "string"), ("page_start", "bigint"), ("block_id", "string"), ("ordinal", "bigint"))], "n")
    return issue(found, "REPORT_COUNT_MISMATCH", "error", stage, F.concat_ws(" ", F.lit(name), F.lit(reported), F.col("n")))


def ratios(report: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    """Q14, Q15 of report rows (document_id, short_fragment_ratio, source_pages, pages_requiring_review)."""
    row = report.withColumns({"page_start": F.lit(None).cast("bigint"), "block_id": F.lit(None).cast("string"), "ordinal": F.lit(None).cast("bigint")})
    share = F.col("pages_requiring_review") / F.col("source_pages")
    return issue(row.where(F.col("short_fragment_ratio") > config.short_ratio), "HIGH_SHORT_FRAGMENT_RATIO", "warning", "normalization", F.col("short_fragment_ratio")).unionByName(
        issue(row.where((F.col("source_pages") > 0) & (share > config.review_ratio)), "EXCESSIVE_REVIEW_PAGE_RATIO", "warning", "normalization", share)
    )


def marker_issues(lines: DataFrame, restorations: DataFrame) -> DataFrame:
    """Q1-Q3 of markdown lines (document_id, line_no, line): undecoded formulas, an error unless exactly one restoration
    (document_id, line_no, page, text) stands for the line (J14)."""
    hit = lines.where(F.col("line").contains(MARKER))
    once = restorations.groupBy("document_id", "line_no").agg(F.count("*").alias("n"), F.first("page").alias("page")).where("n = 1")
    at = hit.join(once, ["document_id", "line_no"], "left").withColumns({"page_start": F.col("page"), "block_id": F.lit(None).cast("string"), "ordinal": F.col("line_no").cast("bigint")})
    fixed = at.where("page is not null")
    return reduce(
        DataFrame.unionByName,
        [
            issue(at.where("page is null"), "FORMULA_NOT_DECODED", "error", "conversion", F.col("line_no")),
            issue(fixed, "FORMULA_NOT_DECODED", "warning", "conversion", F.col("line_no")),
            issue(fixed, "FORMULA_RESTORED_BY_CORRECTION", "warning", "normalization", F.col("line_no")),
            issue(at, "TEXT_EXPECTS_MISSING_FORMULA", "warning", "conversion", F.col("line_no")),
        ],
    )


#: What to do about each kind of issue.
HINTS = {
    "FORMULA_NOT_DECODED": "Restore the formula by a correction with its evidence.",
    "FORMULA_RESTORED_BY_CORRECTION": "Compare the restored formula with the page image.",
    "TEXT_EXPECTS_MISSING_FORMULA": "Read the text around the missing formula.",
    "REPORT_COUNT_MISMATCH": "Write the report and its rows again in one run.",
    "EMPTY_BLOCK": "Drop or restore the empty block in the normalization.",
    "ORPHAN_PUNCTUATION_BLOCK": "Join the mark with the text before it.",
    "INVALID_PAGE_RANGE": "Take the page range from the source again.",
    "MISSING_IMAGE_TARGET": "Copy the image into the artifacts or remove its path.",
    "VERY_SHORT_TEXT_BLOCK": "Look at the page: a label may have become text.",
    "HEADING_LIKE_PARAGRAPH": "Reclassify the paragraph if it is a heading.",
    "SUSPICIOUS_WORD_SPACING": "Remove the space inside the address or word.",
    "POSSIBLE_FIGURE_LABEL_SEQUENCE": "Exclude the labels of the figure from the index.",
    "POSSIBLE_READING_ORDER_BREAK": "Restore the order of the lines.",
    "HIGH_SHORT_FRAGMENT_RATIO": "Look at the pages with many short texts.",
    "EXCESSIVE_REVIEW_PAGE_RATIO": "Review the pages named in the report.",
    "EMPTY_CHUNK": "Chunk the blocks again.",
    "CHUNK_EXCEEDS_CONFIGURED_LIMIT": "Chunk again within the limit.",
    "BROKEN_BLOCK_REFERENCE": "Chunk again from the present blocks.",
}
STAGES = ("conversion", "normalization", "chunking")


@dataclass(frozen=True)
class Artifacts:
    """What an audit reads. Reports, Markdown lines, restorations and the listing of files are optional; their rules need them."""

    blocks: DataFrame
    chunks: DataFrame
    reported_blocks: int | None = None
    reported_chunks: int | None = None
    reported_inputs: int | None = None
    normalization_report: DataFrame | None = None
    lines: DataFrame | None = None
    restorations: DataFrame | None = None
    files: DataFrame | None = None


def full(a: Artifacts, config: AuditConfig = AuditConfig()) -> DataFrame:
    """All rules (T21): issue rows with ``remediation_hint`` and ``issue_no``, by stage, document, place and code."""
    found = [block_issues(a.blocks), chunk_issues(a.chunks, a.blocks, config)]
    if a.lines is not None:
        none = a.lines.sparkSession.createDataFrame([], "document_id string, line_no bigint, page bigint, text string")
        found.append(marker_issues(a.lines, a.restorations if a.restorations is not None else none))
    if a.files is not None:
        found.append(missing_images(a.blocks, a.files))
    if a.normalization_report is not None:
        found.append(ratios(a.normalization_report, config))
    for rows, n, stage, name in ((a.blocks, a.reported_blocks, "normalization", "normalized_block_count"), (a.chunks, a.reported_chunks, "chunking", "output_chunk_count"), (a.blocks, a.reported_inputs, "chunking", "input_block_count")):
        if n is not None:
            found.append(count_mismatch(rows, n, stage, name))
    whole = reduce(DataFrame.unionByName, found)
    hint = F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])[F.col("issue_code")]
    stage = F.array_position(F.array(*map(F.lit, STAGES)), F.col("pipeline_stage"))
    order = Window.partitionBy("pipeline_stage", "document_id").orderBy(F.coalesce("block_ordinal", "chunk_ordinal").asc_nulls_first(), "issue_code", "block_id", "chunk_id", "evidence")
    return whole.withColumn("remediation_hint", hint).withColumn("stage_no", stage).withColumn("issue_no", F.row_number().over(order))


def report(issues: DataFrame) -> DataFrame:
    """One row for each document: errors, warnings and whether it passed (SNK8)."""
    n = issues.groupBy("document_id").agg(F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"))
    return n.withColumn("passed", F.col("error_count") == 0)


def summary(issues: DataFrame) -> DataFrame:
    """(severity, n) and whether there is no error (AGG9)."""
    return issues.groupBy("severity").agg(F.count("*").alias("n"))
