"""Checks over tables in which every rule is broken somewhere: the given rows, some of them changed by their place in the reading order,
so that each rule has rows to find. All rows stay in; both sides make the same changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import ids
from quillmesh.functions.text import trimmed
from quillmesh.operators import audit, baseline, corpus, dense, evaluation, sequences
from quillmesh.plans.block_queries import _ORPHANS, AUDIT_BLOCKS_SQL, BLOCKS_SQL, blocks_of, trim_sql
from quillmesh.plans.register import query
from quillmesh.plans.retrieval_queries import CASES_SQL, CHUNKS_SQL, cases_of, chunks_of
from quillmesh.sources.tables import table

_AT = "ordinal % 23"
#: Of every 23 blocks of a document: lone punctuation, a numbered short paragraph, two figure labels before a caption, pages the wrong way round.
BROKEN_SQL = BLOCKS_SQL.replace("b AS", "b0 AS", 1) + f""", b AS (SELECT * REPLACE (
    CASE {_AT} WHEN 3 THEN '。' WHEN 7 THEN '3.2 标题' WHEN 11 THEN 'a)' WHEN 12 THEN '(b)' WHEN 15 THEN 'x' ELSE text END AS text,
    CASE WHEN {_AT} IN (2, 3, 7, 11, 12, 15) THEN 'paragraph' WHEN {_AT} = 13 THEN 'figure_caption' ELSE block_type END AS block_type,
    CASE WHEN {_AT} IN (2, 3) THEN NULL ELSE image_path END AS image_path, CASE {_AT} WHEN 17 THEN page_start - 1 ELSE page_end END AS page_end) FROM b0)"""


def broken_blocks(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("ordinal") % 23
    texts = {3: "。", 7: "3.2 标题", 11: "a)", 12: "(b)", 15: "x"}
    text: Column = F.col("text")
    for k, v in texts.items():
        text = F.when(at == k, v).otherwise(text)
    kind = F.when(at.isin(2, 3, 7, 11, 12, 15), "paragraph").when(at == 13, "figure_caption").otherwise(F.col("block_type"))
    image = F.when(~at.isin(2, 3), F.col("image_path"))
    return blocks_of(spark, d).withColumns({"text": text, "block_type": kind, "image_path": image, "page_end": F.when(at == 17, F.col("page_start") - 1).otherwise(F.col("page_end"))})


@query(f"WITH {AUDIT_BLOCKS_SQL.replace(BLOCKS_SQL, BROKEN_SQL, 1)} SELECT issue_code, severity, block_id FROM issues WHERE issue_code <> 'SUSPICIOUS_WORD_SPACING'")
def audit_blocks_broken(spark: SparkSession, d: str) -> DataFrame:
    return audit.block_issues(broken_blocks(spark, d)).select("issue_code", "severity", "block_id").where("issue_code <> 'SUSPICIOUS_WORD_SPACING'")


@query(
    f"""WITH {BROKEN_SQL}, s AS (SELECT *, substr(text, length(text), 1) AS tail FROM b),
    o AS (SELECT *, coalesce(lag(1) OVER w IS NOT NULL AND text IN {_ORPHANS} AND block_type IN ('paragraph', 'list_item'), false) AS orph FROM s WINDOW w AS (PARTITION BY document_id ORDER BY ordinal, block_id)),
    m AS (SELECT *, coalesce(orph AND NOT lag(orph) OVER w AND lag(block_type) OVER w IN ('paragraph', 'list_item') AND image_path IS NULL AND (lag(image_path) OVER w) IS NULL AND lag(tail) OVER w NOT IN {_ORPHANS} AND lag(page_start) OVER w = page_start AND lag(page_end) OVER w = page_end, false) AS mrg FROM o WINDOW w AS (PARTITION BY document_id ORDER BY ordinal, block_id)),
    g AS (SELECT *, coalesce(lead(mrg) OVER w, false) AS gets, lead(text) OVER w AS nxt FROM m WINDOW w AS (PARTITION BY document_id ORDER BY ordinal, block_id))
    SELECT block_id, CASE WHEN gets THEN text || nxt ELSE text END AS text, CASE WHEN orph THEN 'figure_label' ELSE block_type END AS block_type, mrg::INT AS merged, (orph AND NOT mrg)::INT AS relabelled FROM g"""
)
def orphan_punct_broken(spark: SparkSession, d: str) -> DataFrame:
    return sequences.orphan_punctuation(broken_blocks(spark, d)).select("block_id", "text", "block_type", "merged", "relabelled")


@query(
    f"""WITH {CHUNKS_SQL.replace("c AS", "c0 AS", 1)}, {BLOCKS_SQL}, c AS (SELECT * REPLACE (CASE ordinal % 5 WHEN 1 THEN list_append(block_ids, 'missing:' || chunk_id) WHEN 2 THEN list_append(block_ids, block_ids[1]) ELSE block_ids END AS block_ids,
      CASE ordinal % 7 WHEN 3 THEN page_start - 1 ELSE page_end END AS page_end, CASE ordinal % 11 WHEN 5 THEN '  ' ELSE content END AS content) FROM c0), issues AS (
    SELECT 'EMPTY_CHUNK' AS issue_code, chunk_id FROM c WHERE content IS NULL OR index_text IS NULL OR {trim_sql('content')} = '' OR {trim_sql('index_text')} = ''
    UNION ALL SELECT 'INVALID_PAGE_RANGE', chunk_id FROM c WHERE page_start IS NULL OR page_end IS NULL OR page_start < 1 OR page_end < page_start
    UNION ALL SELECT 'CHUNK_EXCEEDS_CONFIGURED_LIMIT', chunk_id FROM c WHERE length(index_text) > 1200
    UNION ALL (SELECT 'BROKEN_BLOCK_REFERENCE', chunk_id FROM (SELECT chunk_id, unnest(block_ids) AS x FROM c) WHERE x NOT IN (SELECT block_id FROM b) UNION SELECT 'BROKEN_BLOCK_REFERENCE', chunk_id FROM c WHERE len(block_ids) <> len(list_distinct(block_ids))))
    SELECT issue_code, chunk_id FROM issues"""
)
def audit_chunks_broken(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("ordinal")
    refs = F.when(at % 5 == 1, F.array_append("block_ids", F.concat(F.lit("missing:"), "chunk_id"))).when(at % 5 == 2, F.array_append("block_ids", F.try_element_at("block_ids", F.lit(1)))).otherwise(F.col("block_ids"))
    pages = F.when(at % 7 == 3, F.col("page_start") - 1).otherwise(F.col("page_end"))
    c = chunks_of(spark, d).withColumns({"block_ids": refs, "page_end": pages, "content": F.when(at % 11 == 5, "  ").otherwise(F.col("content"))})
    return audit.chunk_issues(c, blocks_of(spark, d)).select("issue_code", "chunk_id")


@query(f"WITH {CHUNKS_SQL}, {CASES_SQL} SELECT case_id, 'gone:' || case_id AS chunk_id FROM q WHERE relevant_chunk_ids IS NOT NULL UNION SELECT case_id, x FROM (SELECT case_id, unnest(relevant_chunk_ids) AS x FROM q) WHERE NOT EXISTS (SELECT 1 FROM c WHERE chunk_id = x)")
def anti_join_refs_broken(spark: SparkSession, d: str) -> DataFrame:
    """Every case refers to one chunk more, which doesn't exist."""
    cases = cases_of(spark, d).withColumn("relevant_chunk_ids", F.array_append("relevant_chunk_ids", F.concat(F.lit("gone:"), "case_id")))
    return evaluation.unknown_relevant(cases, chunks_of(spark, d))


@query(f"WITH {BLOCKS_SQL} SELECT document_id, count(DISTINCT source_path) AS paths, count(DISTINCT normalization_version || (ordinal % 2)) AS versions FROM b GROUP BY ALL HAVING count(DISTINCT source_path) > 1 OR count(DISTINCT normalization_version || (ordinal % 2)) > 1")
def single_values_broken(spark: SparkSession, d: str) -> DataFrame:
    b = blocks_of(spark, d).withColumn("normalization_version", F.concat("normalization_version", F.col("ordinal") % 2))
    by = b.groupBy("document_id").agg(F.count_distinct("source_path").alias("paths"), F.count_distinct("normalization_version").alias("versions"))
    return by.where("paths > 1 or versions > 1")


@query("SELECT count(DISTINCT embedding_version) AS embedding_versions, count(DISTINCT vector.dimensions) AS dimensions FROM vector_records")
def version_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return dense.version_conflicts(table(spark, d, "vector_records", "embedding_version", "vector"))


@query("SELECT book_id, section_id FROM (SELECT book_id, section_id, start_page, lag(end_page) OVER (PARTITION BY book_id ORDER BY start_page, end_page, section_id) AS before FROM (SELECT DISTINCT book_id, section_id, greatest(start_page - 1, 1) AS start_page, end_page FROM book_sections)) WHERE before >= start_page")
def overlapping_sections_broken(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "book_sections").select("book_id", "section_id", F.greatest(F.col("start_page") - 1, F.lit(1)).alias("start_page"), "end_page").distinct()
    return corpus.overlapping(s).select("book_id", "section_id")


@query(
    f"""WITH {BLOCKS_SQL}, f AS (SELECT DISTINCT image_path FROM b WHERE ordinal % 2 = 0 AND image_path IS NOT NULL),
    x AS (SELECT block_id, CASE ordinal % 9 WHEN 0 THEN '../' || image_path ELSE image_path END AS image_path FROM b WHERE image_path IS NOT NULL)
    SELECT block_id, image_path FROM x WHERE image_path LIKE '../%' OR image_path LIKE '/%' OR image_path NOT IN (SELECT image_path FROM f)"""
)
def missing_images(spark: SparkSession, d: str) -> DataFrame:
    """The listing has the images of every second block; some paths leave their folder."""
    b = blocks_of(spark, d)
    files = b.where("ordinal % 2 = 0 and image_path is not null").select(F.col("image_path").alias("path"))
    odd = b.withColumn("image_path", F.when(F.col("ordinal") % 9 == 0, F.concat(F.lit("../"), "image_path")).otherwise(F.col("image_path")))
    return audit.missing_images(odd, files).select("block_id", F.col("evidence").alias("image_path"))


@query(
    f"""WITH {BLOCKS_SQL}, r AS (SELECT document_id, avg((length(coalesce({trim_sql('text')}, '')) <= 20)::INT) AS short, count(DISTINCT page_start) AS pages, count(DISTINCT CASE WHEN block_type = 'figure_label' THEN page_start END) AS review FROM b GROUP BY ALL)
    SELECT 'HIGH_SHORT_FRAGMENT_RATIO' AS issue_code, document_id FROM r WHERE short > 0.04 UNION ALL SELECT 'EXCESSIVE_REVIEW_PAGE_RATIO', document_id FROM r WHERE pages > 0 AND review / pages > 0.25"""
)
def audit_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a figure label stand for those to be reviewed, texts up to 20 characters for fragments."""
    short = F.avg((F.char_length(F.coalesce(trimmed(F.col("text")), F.lit(""))) <= 20).cast("double"))
    review = F.count_distinct(F.when(F.col("block_type") == "figure_label", F.col("page_start")))
    r = blocks_of(spark, d).groupBy("document_id").agg(short.alias("short_fragment_ratio"), F.count_distinct("page_start").alias("source_pages"), review.alias("pages_requiring_review"))
    return audit.ratios(r).select("issue_code", "document_id")


@query(f"WITH {CHUNKS_SQL}, {BLOCKS_SQL} SELECT 'normalization' AS pipeline_stage, 'normalized_block_count 7 ' || count(*) AS evidence FROM b HAVING count(*) <> 7 UNION ALL SELECT 'chunking', 'output_chunk_count 7 ' || count(*) FROM c HAVING count(*) <> 7")
def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reports that claim seven rows each."""
    found = audit.count_mismatch(blocks_of(spark, d), 7, "normalization", "normalized_block_count").unionByName(audit.count_mismatch(chunks_of(spark, d), 7, "chunking", "output_chunk_count"))
    return found.select("pipeline_stage", "evidence")


@query(
    f"""WITH {BLOCKS_SQL}, m AS (SELECT document_id, ordinal AS line_no, ordinal % 3 = 0 AS restored FROM b WHERE block_type = 'equation')
    SELECT 'FORMULA_NOT_DECODED' AS issue_code, CASE WHEN restored THEN 'warning' ELSE 'error' END AS severity, document_id, line_no FROM m
    UNION ALL SELECT 'FORMULA_RESTORED_BY_CORRECTION', 'warning', document_id, line_no FROM m WHERE restored UNION ALL SELECT 'TEXT_EXPECTS_MISSING_FORMULA', 'warning', document_id, line_no FROM m"""
)
def audit_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Equations stand for undecoded formulas; every third is restored once, every other third twice, which counts as not restored."""
    b = blocks_of(spark, d)
    equation = F.col("block_type") == "equation"
    lines = b.select("document_id", F.col("ordinal").alias("line_no"), F.when(equation, "<!-- formula-not-decoded -->").otherwise(F.coalesce("text", F.lit(""))).alias("line"))
    one = b.where(equation).where("ordinal % 3 < 2").select("document_id", F.col("ordinal").alias("line_no"), F.col("page_start").alias("page"))
    restored = one.unionByName(one.where("line_no % 3 = 1"))
    return audit.marker_issues(lines.where("line not like '%formula-not-decoded%' or line = '<!-- formula-not-decoded -->'"), restored).select("issue_code", "severity", "document_id", F.col("block_ordinal").alias("line_no"))


_H = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk:' || chunk_id))"


@query(
    f"""WITH {CHUNKS_SQL}, h AS (SELECT chunk_id, {_H} AS h FROM c)
    SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h"""
)
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d).select("chunk_id", ids.point_id(F.col("chunk_id")).alias("point_id"))


@query(
    f"""WITH {CHUNKS_SQL}, {BLOCKS_SQL}, l AS (SELECT DISTINCT unnest(block_ids) AS k FROM c), r AS (SELECT block_id AS k FROM b)
    SELECT coalesce(l.k, r.k) AS k, CASE WHEN l.k IS NULL THEN 'right' ELSE 'left' END AS side FROM l FULL JOIN r ON l.k = r.k WHERE l.k IS NULL OR r.k IS NULL"""
)
def key_set_equality(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that no chunk refers to, and references to no block."""
    refs = chunks_of(spark, d).select(F.explode("block_ids").alias("k"))
    return sequences.unequal_keys(refs, blocks_of(spark, d).select(F.col("block_id").alias("k")), "k")


@query(
    """WITH n AS (SELECT vec_id, max(epoch_us(ingested_at)) AS taken, count(*) AS n FROM vector_records WHERE vec_id IS NOT NULL AND ingested_at IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
    o AS (SELECT vec_id, min(epoch_us(ingested_at)) AS taken FROM vector_records WHERE vec_id IS NOT NULL AND ingested_at IS NOT NULL GROUP BY ALL)
    SELECT vec_id, taken, 'kept' AS origin FROM o WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT vec_id, taken, 'replaced' FROM n"""
)
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Whole records: of each the first one taken in is the table, and the last one of those that came again is upserted."""
    rows = table(spark, d, "vector_records").where("vec_id is not null and ingested_at is not null")
    row = F.struct(*[F.col(c) for c in rows.columns])
    by = rows.groupBy("vec_id").agg(F.min_by(row, "ingested_at").alias("old"), F.max_by(row, "ingested_at").alias("new"), F.count("*").alias("n"))
    old = by.select("old.*", F.lit("kept").alias("origin"))
    new = by.where("n > 1").select("new.*", F.lit("replaced").alias("origin"))
    return dense.upsert(old, new, "vec_id").select("vec_id", F.unix_micros("ingested_at").alias("taken"), "origin")


# ---------------------------------------------------------------- cases from headings, the baseline's audit

_OUTLINE = r"^(?:[0-9]+(?:\.[0-9]+){1,3}[\s\x{0b}\x{a0}\x{2000}-\x{200a}\x{3000}]|第[一二三四五六七八九十百千0-9]+[章节篇部分])"


@query(
    f"""WITH {BLOCKS_SQL}, t AS (SELECT *, {trim_sql('text')} AS x FROM b WHERE block_type IN ('paragraph', 'list_item') AND text IS NOT NULL)
    SELECT block_id FROM t WHERE x <> '' AND (regexp_matches(x, '{_OUTLINE}') OR (length(x) <= 24 AND substr(x, length(x), 1) NOT IN ('。', '；', '，', '！', '？', '.', ';', ',')))"""
)
def heading_candidates(spark: SparkSession, d: str) -> DataFrame:
    return baseline.heading_candidates(blocks_of(spark, d)).select("block_id")


_REVIEW_SQL = "r AS (SELECT DISTINCT document_id, page_start AS page FROM b WHERE block_type = 'figure_label' AND page_start IS NOT NULL)"


def _review_pages(blocks: DataFrame) -> DataFrame:
    return blocks.where("block_type = 'figure_label' and page_start is not null").select("document_id", F.col("page_start").alias("page")).distinct()


@query(
    f"""WITH {BLOCKS_SQL}, {_REVIEW_SQL}, f AS (SELECT document_id, page_start AS page, arg_min(coalesce(heading_path, []), (ordinal, block_id)) AS p FROM b GROUP BY ALL)
    SELECT document_id, page, array_to_string(p, ' / ') AS context FROM r LEFT JOIN f USING (document_id, page)"""
)
def page_context(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a figure label stand for those to be reviewed."""
    b = blocks_of(spark, d)
    return baseline.page_context(b, _review_pages(b))


@query(
    f"""WITH {BLOCKS_SQL}, f AS (SELECT DISTINCT regexp_extract(image_path, '[^/]+$') AS name FROM b WHERE image_path IS NOT NULL), k AS (SELECT DISTINCT regexp_extract(image_path, '[^/]+$') AS name FROM b WHERE image_path IS NOT NULL AND ordinal % 2 = 0)
    SELECT name FROM f WHERE name NOT IN (SELECT name FROM k)"""
)
def unregistered_images(spark: SparkSession, d: str) -> DataFrame:
    """The images of every second block stand for those that are registered."""
    b = blocks_of(spark, d).withColumn("path", F.col("image_path"))
    return baseline.unregistered(b.select("path"), b.where("ordinal % 2 = 0").select("path"))


@query(
    f"""WITH {BLOCKS_SQL}, {CHUNKS_SQL}, p AS (SELECT document_id, ordinal AS n, {trim_sql('text')} AS heading FROM b WHERE block_type = 'section_heading' AND text IS NOT NULL AND {trim_sql('text')} <> ''),
    u AS (SELECT DISTINCT document_id, chunk_id, ordinal, unnest(heading_path) AS heading FROM c)
    SELECT document_id, n, chunk_id, row_number() OVER (PARTITION BY document_id, n ORDER BY ordinal, chunk_id) AS place FROM p JOIN u USING (document_id, heading)"""
)
def section_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The chunks under each section heading, anywhere in their path."""
    probes = evaluation.section_probes(blocks_of(spark, d))
    rows = evaluation.relevant_under(probes, chunks_of(spark, d))
    return rows.select("document_id", F.regexp_extract("case_id", r"^section-(\d+)-", 1).cast("bigint").alias("n"), "chunk_id", "place")


@query(
    f"""WITH {BLOCKS_SQL}, {CHUNKS_SQL}, p AS (SELECT DISTINCT document_id, heading_path[1] AS heading FROM c WHERE heading_path[1] IS NOT NULL AND trim(heading_path[1]) <> ''), u AS (SELECT DISTINCT document_id, chunk_id, ordinal, content, unnest(heading_path) AS heading FROM c)
    SELECT document_id, heading, chunk_id, row_number() OVER (PARTITION BY document_id, heading ORDER BY ordinal, chunk_id) AS place FROM p JOIN u USING (document_id, heading) WHERE contains(coalesce(content, ''), 'TCP')"""
)
def semantic_relevance(spark: SparkSession, d: str) -> DataFrame:
    """For each chapter of each document the chunks that mention TCP."""
    c = chunks_of(spark, d)
    chapter = F.try_element_at("heading_path", F.lit(1))
    probes = c.select("document_id", chapter.alias("heading")).distinct().where("heading is not null").select("document_id", F.col("heading").alias("case_id"), "heading", F.lit("TCP").alias("text"))
    return evaluation.relevant_under(probes, c).withColumnRenamed("case_id", "heading")


@query(
    f"""WITH {BLOCKS_SQL}, {_REVIEW_SQL}, t AS (SELECT *, {trim_sql('text')} AS x FROM b WHERE block_type IN ('paragraph', 'list_item') AND text IS NOT NULL),
    h AS (SELECT document_id, count(*) AS candidates FROM t WHERE x <> '' AND (regexp_matches(x, '{_OUTLINE}') OR (length(x) <= 24 AND substr(x, length(x), 1) NOT IN ('。', '；', '，', '！', '？', '.', ';', ','))) GROUP BY ALL),
    n AS (SELECT document_id, count(*) AS blocks, count_if(block_type IN ('document_title', 'section_heading'))::BIGINT AS headings, count_if(block_type = 'figure_caption')::BIGINT AS captions FROM b GROUP BY ALL), v AS (SELECT document_id, count(*) AS review_pages FROM r GROUP BY ALL)
    SELECT document_id, blocks, headings, captions, coalesce(candidates, 0) AS candidates, coalesce(review_pages, 0) AS review_pages FROM n LEFT JOIN h USING (document_id) LEFT JOIN v USING (document_id)"""
)
def baseline_overview(spark: SparkSession, d: str) -> DataFrame:
    b = blocks_of(spark, d)
    return baseline.overview(b, _review_pages(b))
