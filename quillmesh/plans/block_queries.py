"""Queries over blocks, chunks as tables, events and the star schema: ordered operators, joins, audit, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text
from quillmesh.operators import audit, chunking, corpus, sequences
from quillmesh.plans.register import query
from quillmesh.plans.retrieval_queries import CHUNKS_SQL, chunks_of
from quillmesh.sources.tables import once, table

BLOCKS_SQL = "b AS (SELECT DISTINCT ON (block_id) * FROM normalized_blocks WHERE block_id IS NOT NULL ORDER BY block_id, ingested_at)"
_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"


def terminal_sql(c: str) -> str:
    return rf"""regexp_matches({c}, '[。！？.!?](?:[”’"''）)\]】》〉]|{_SPACES})*$')"""


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


def normalize_sql(c: str) -> str:
    """The layout rules without look-around: pairs that share a character need a second pass."""
    out = f"trim(regexp_replace({c}, '{_SPACES}+', ' ', 'g'))"
    twice = 2
    for pattern, by, passes in (
        (r"(\d)\. +(\d)", r"\1.\2", twice),
        (rf"([{_HAN}]) +([{_HAN}])", r"\1\2", twice),
        (r" +([，。；：？！、）】》])", r"\1", 1),
        (r"([，。；：？！、]) +", r"\1", 1),
        (r"([（【《]) +", r"\1", 1),
        (r" +([（【《])", r"\1", 1),
        (rf"([）】》]) +([{_HAN}])", r"\1\2", 1),
        (r"([A-Za-z0-9]) */ *([A-Za-z0-9])", r"\1/\2", twice),
        (r" +([％%])", r"\1", 1),
    ):
        for _ in range(passes):
            out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out})"


def blocks_of(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "normalized_blocks"), "block_id")


@query(f"WITH {BLOCKS_SQL} SELECT block_id, {normalize_sql('text')} AS text FROM b")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return blocks_of(spark, d).select("block_id", text.normalize_text(F.col("text")).alias("text"))


@query(f"WITH {BLOCKS_SQL} SELECT block_type, count(*) AS blocks, sum(coalesce({terminal_sql('text')}, false)::INT)::BIGINT AS finished FROM b GROUP BY ALL")
def sentence_final(spark: SparkSession, d: str) -> DataFrame:
    return blocks_of(spark, d).groupBy("block_type").agg(F.count("*").alias("blocks"), F.count_if(text.ends_sentence(F.col("text"))).alias("finished"))


@query(
    f"""WITH {BLOCKS_SQL}, o AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at, block_id) AS i, row_number() OVER (PARTITION BY document_id ORDER BY page_start, ordinal, block_id) AS j FROM b)
    SELECT document_id, count_if(i <> j)::BIGINT AS moved FROM o GROUP BY ALL"""
)
def reading_order_changes(spark: SparkSession, d: str) -> DataFrame:
    b = blocks_of(spark, d)
    items = b.select("document_id", F.struct("ingested_at", "block_id").alias("original_index"), F.col("page_start").alias("page"), F.col("ordinal").alias("top"), F.col("block_id").alias("left"))
    return sequences.moved(items)


GROUPS_SQL = f"""{BLOCKS_SQL}, r AS (SELECT *, block_type IN ('document_title', 'section_heading') AS ctl FROM b WHERE block_type <> 'figure_label'),
m AS (SELECT *, CASE WHEN ctl OR coalesce(lag(ctl) OVER w, true) OR heading_path IS DISTINCT FROM lag(heading_path) OVER w THEN 1 ELSE 0 END AS brk FROM r WINDOW w AS (PARTITION BY document_id ORDER BY ordinal, block_id)),
g AS (SELECT * FROM (SELECT *, sum(brk) OVER (PARTITION BY document_id ORDER BY ordinal, block_id) AS group_no FROM m) WHERE NOT ctl)"""


@query(f"WITH {GROUPS_SQL} SELECT document_id, group_no::BIGINT AS group_no, count(*) AS blocks, min(ordinal) AS first_ordinal FROM g GROUP BY ALL")
def body_groups(spark: SparkSession, d: str) -> DataFrame:
    g = sequences.body_groups(blocks_of(spark, d))
    return g.groupBy("document_id", F.col("group_no").cast("bigint").alias("group_no")).agg(F.count("*").alias("blocks"), F.min("ordinal").alias("first_ordinal"))


@query(
    f"""WITH {GROUPS_SQL}, x AS (SELECT *, coalesce(lag(block_type) OVER w = 'paragraph' AND block_type = 'paragraph' AND lag(heading_path) OVER w IS NOT DISTINCT FROM heading_path AND ordinal = lag(ordinal) OVER w + 1
      AND page_start = lag(page_end) OVER w + 1 AND NOT coalesce({terminal_sql('lag(text) OVER w')}, false), false) AS cont FROM g WINDOW w AS (PARTITION BY document_id, group_no ORDER BY ordinal, block_id))
    SELECT document_id, count(*) - sum(cont::INT)::BIGINT AS units, sum(cont::INT)::BIGINT AS joins FROM x GROUP BY ALL"""
)
def crosspage_join(spark: SparkSession, d: str) -> DataFrame:
    u = sequences.content_units(sequences.body_groups(blocks_of(spark, d)))
    return u.groupBy("document_id").agg(F.count("*").alias("units"), F.sum("joins").cast("bigint").alias("joins"))


UNITS_SQL = f"""{GROUPS_SQL}, x AS (SELECT *, coalesce(lag(block_type) OVER w = 'paragraph' AND block_type = 'paragraph' AND lag(heading_path) OVER w IS NOT DISTINCT FROM heading_path AND ordinal = lag(ordinal) OVER w + 1
      AND page_start = lag(page_end) OVER w + 1 AND NOT coalesce({terminal_sql('lag(text) OVER w')}, false), false) AS cont FROM g WHERE text IS NOT NULL WINDOW w AS (PARTITION BY document_id, group_no ORDER BY ordinal, block_id)),
    y AS (SELECT *, sum((NOT cont)::INT) OVER (PARTITION BY document_id, group_no ORDER BY ordinal, block_id) AS unit_no, lead(cont) OVER (PARTITION BY document_id, group_no ORDER BY ordinal, block_id) AS more,
      regexp_matches(lag(regexp_replace(text, '{_SPACES}+$', '')) OVER (PARTITION BY document_id, group_no ORDER BY ordinal, block_id), '[A-Za-z0-9]$') AND regexp_matches(regexp_replace(text, '^{_SPACES}+', ''), '^[A-Za-z0-9]') AS spaced FROM x),
    z AS (SELECT *, CASE WHEN cont AND spaced THEN ' ' ELSE '' END || CASE WHEN cont AND more THEN {trim_sql('text')} WHEN cont THEN regexp_replace(text, '^{_SPACES}+', '') WHEN more THEN regexp_replace(text, '{_SPACES}+$', '') ELSE text END AS part FROM y),
    u AS (SELECT document_id, group_no, unit_no, string_agg(block_id, ',' ORDER BY ordinal, block_id) AS block_ids, string_agg(part, '' ORDER BY ordinal, block_id) AS text, min(page_start) AS page_start, max(page_end) AS page_end FROM z GROUP BY ALL)"""


@query(f"WITH {UNITS_SQL} SELECT document_id, block_ids, text, page_start, page_end FROM u")
def unit_texts(spark: SparkSession, d: str) -> DataFrame:
    """What is packed into chunks: body blocks, paragraphs that go on over a page as one text."""
    body = blocks_of(spark, d).where(F.col("text").isNotNull() | F.col("block_type").isin(*sequences.CONTROL))
    u = sequences.content_units(sequences.body_groups(body))
    return u.select("document_id", F.array_join("block_ids", ",").alias("block_ids"), "text", "page_start", "page_end")


_ORPHANS = "('" + "','".join(text.ORPHANS) + "')"


@query(
    f"""WITH {BLOCKS_SQL}, s AS (SELECT *, substr(text, length(text), 1) AS tail, block_type IN ('paragraph', 'list_item', 'figure_label') AS body0 FROM b),
    o AS (SELECT *, coalesce(lag(1) OVER w IS NOT NULL AND text IN {_ORPHANS} AND block_type IN ('paragraph', 'list_item'), false) AS orph FROM s WINDOW w AS (PARTITION BY document_id ORDER BY ordinal, block_id)),
    m AS (SELECT *, coalesce(orph AND NOT lag(orph) OVER w AND lag(block_type) OVER w IN ('paragraph', 'list_item') AND image_path IS NULL AND (lag(image_path) OVER w) IS NULL AND lag(tail) OVER w NOT IN {_ORPHANS} AND lag(page_start) OVER w = page_start AND lag(page_end) OVER w = page_end, false) AS mrg FROM o WINDOW w AS (PARTITION BY document_id ORDER BY ordinal, block_id))
    SELECT document_id, count_if(orph)::BIGINT AS orphans, count_if(mrg)::BIGINT AS merged FROM m GROUP BY ALL"""
)
def orphan_punct_merge(spark: SparkSession, d: str) -> DataFrame:
    out = sequences.orphan_punctuation(blocks_of(spark, d))
    return out.groupBy("document_id").agg(F.sum(F.col("merged") + F.col("relabelled")).alias("orphans"), F.sum("merged").alias("merged"))


@query(f"WITH {BLOCKS_SQL} SELECT block_id, lag(text) OVER w AS before_text, lead(text) OVER w AS after_text FROM b WINDOW w AS (PARTITION BY document_id ORDER BY ordinal, block_id)")
def anchor_context(spark: SparkSession, d: str) -> DataFrame:
    return sequences.anchors(blocks_of(spark, d)).select("block_id", "before_text", "after_text")


@query(
    """SELECT e.event_id, v.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON e.user_id = v.user_id AND e.ts > v.ts"""
)
def asof_anchor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view"))
    out = sequences.asof_before(e.where("event_type = 'error'").drop("event_type"), views, "user_id", "ts", "view")
    return out.select("event_id", F.col("last_view"))


@query(f"WITH {CHUNKS_SQL}, s AS (SELECT DISTINCT book_id, section_id, start_page, end_page FROM book_sections) SELECT chunk_id, section_id FROM c JOIN s ON book_id = document_id AND page_start <= s.end_page AND page_end >= s.start_page")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    return sequences.pages_meet(chunks_of(spark, d), table(spark, d, "book_sections", "book_id", "section_id", "start_page", "end_page").distinct())


@query(
    f"""WITH {CHUNKS_SQL}, w AS (SELECT DISTINCT book_id, unnest(generate_series(start_page, end_page)) AS page FROM book_sections), h AS (SELECT DISTINCT document_id AS book_id, unnest(generate_series(page_start, page_end)) AS page, 1 AS x FROM c)
    SELECT book_id, count(*) AS expected, count(x) AS covered, round(count(x) / count(*), 9) AS coverage FROM w LEFT JOIN h USING (book_id, page) GROUP BY ALL"""
)
def page_coverage(spark: SparkSession, d: str) -> DataFrame:
    return sequences.page_coverage(chunks_of(spark, d), table(spark, d, "book_sections")).withColumn("coverage", F.round("coverage", 9))


def _boxes(df: DataFrame, key: str, a: int, b: int, size: int) -> DataFrame:
    x, y = F.col(key) * a % 1000, F.col(key) * b % 1000
    return df.select(F.col(key).alias("id"), x.alias("x0"), (x + size).alias("x1"), y.alias("y0"), (y + size).alias("y1"))


@query(
    """WITH a AS (SELECT p_partkey AS id, p_partkey * 37 % 1000 AS x, p_partkey * 101 % 1000 AS y FROM part), s AS (SELECT s_suppkey AS id, s_suppkey * 59 % 1000 AS x, s_suppkey * 83 % 1000 AS y FROM supplier)
    SELECT a.id AS id_a, s.id AS id_b FROM a, s WHERE a.x < s.x + 40 AND s.x < a.x + 25 AND a.y < s.y + 40 AND s.y < a.y + 25"""
)
def bbox_intersect(spark: SparkSession, d: str) -> DataFrame:
    return sequences.boxes_meet(_boxes(table(spark, d, "part", "p_partkey"), "p_partkey", 37, 101, 25), _boxes(table(spark, d, "supplier", "s_suppkey"), "s_suppkey", 59, 83, 40))


@query("SELECT block_id, count(*) AS n FROM normalized_blocks GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return sequences.duplicates(table(spark, d, "normalized_blocks", "block_id"), "block_id")


@query(f"WITH {BLOCKS_SQL} SELECT document_id, count(DISTINCT source_path) AS paths, count(DISTINCT normalization_version) AS versions FROM b GROUP BY ALL HAVING count(DISTINCT source_path) > 1 OR count(DISTINCT normalization_version) > 1")
def single_values(spark: SparkSession, d: str) -> DataFrame:
    by = blocks_of(spark, d).groupBy("document_id").agg(F.count_distinct("source_path").alias("paths"), F.count_distinct("normalization_version").alias("versions"))
    return by.where("paths > 1 or versions > 1")


@query(
    f"""WITH {CHUNKS_SQL}, s AS (SELECT book_id, section_id, start_page, end_page FROM book_sections WHERE include_in_index), p AS (SELECT chunk_id, book_id, section_id, start_page, ordinal, row_number() OVER (PARTITION BY chunk_id ORDER BY start_page, section_id) AS n FROM c JOIN s ON book_id = document_id AND page_start BETWEEN start_page AND end_page)
    SELECT chunk_id, book_id, section_id, row_number() OVER (PARTITION BY book_id ORDER BY start_page, section_id, ordinal, chunk_id) AS ordinal FROM p WHERE n = 1"""
)
def corpus_assembly(spark: SparkSession, d: str) -> DataFrame:
    return corpus.assembled(chunks_of(spark, d), table(spark, d, "book_sections")).select("chunk_id", "book_id", "section_id", "ordinal")


@query("SELECT book_id, section_id FROM (SELECT book_id, section_id, start_page, lag(end_page) OVER (PARTITION BY book_id ORDER BY start_page, end_page, section_id) AS before FROM (SELECT DISTINCT book_id, section_id, start_page, end_page FROM book_sections)) WHERE before >= start_page")
def overlapping_sections(spark: SparkSession, d: str) -> DataFrame:
    return corpus.overlapping(table(spark, d, "book_sections").select("book_id", "section_id", "start_page", "end_page").distinct()).select("book_id", "section_id")


@query(
    f"""WITH {BLOCKS_SQL} SELECT document_id, count(*) AS blocks, round(avg((length(coalesce({trim_sql('text')}, '')) <= 3)::INT), 9) AS short_fragment_ratio, count(DISTINCT page_start) AS pages FROM b GROUP BY ALL"""
)
def normalization_counters(spark: SparkSession, d: str) -> DataFrame:
    short = F.avg((F.char_length(F.coalesce(text.trimmed(F.col("text")), F.lit(""))) <= 3).cast("double"))
    return blocks_of(spark, d).groupBy("document_id").agg(F.count("*").alias("blocks"), F.round(short, 9).alias("short_fragment_ratio"), F.count_distinct("page_start").alias("pages"))


_LABEL = audit.FIGURE_LABEL
AUDIT_BLOCKS_SQL = f"""{BLOCKS_SQL}, t AS (SELECT *, {trim_sql('text')} AS x FROM b), e AS (SELECT * FROM t WHERE text IS NOT NULL AND x <> ''),
lab AS (SELECT *, coalesce(block_type IN ('paragraph', 'list_item') AND regexp_matches(x, '{_LABEL}'), false) AS l, row_number() OVER w AS rn, max((block_type = 'figure_caption')::INT) OVER (PARTITION BY document_id, page_start ORDER BY ordinal, block_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS cap FROM t WINDOW w AS (PARTITION BY document_id, page_start ORDER BY ordinal, block_id)),
runs AS (SELECT document_id, page_start, count(*) AS n, max(cap) AS c, arg_min(block_id, (ordinal, block_id)) AS block_id FROM (SELECT *, rn - row_number() OVER (PARTITION BY document_id, page_start ORDER BY ordinal, block_id) AS run FROM lab WHERE l) GROUP BY document_id, page_start, run),
nx AS (SELECT *, lead(page_start) OVER w AS np, lead(x) OVER w AS ntext FROM t WINDOW w AS (PARTITION BY document_id ORDER BY ordinal, block_id)),
issues AS (
SELECT 'EMPTY_BLOCK' AS issue_code, 'error' AS severity, block_id FROM t WHERE text IS NULL OR x = ''
UNION ALL SELECT 'ORPHAN_PUNCTUATION_BLOCK', 'error', block_id FROM e WHERE block_type IN ('paragraph', 'list_item') AND x IN {_ORPHANS}
UNION ALL SELECT 'INVALID_PAGE_RANGE', 'error', block_id FROM e WHERE page_start IS NULL OR page_end IS NULL OR page_start < 1 OR page_end < page_start
UNION ALL SELECT 'VERY_SHORT_TEXT_BLOCK', 'warning', block_id FROM e WHERE block_type = 'paragraph' AND length(x) = 1 AND x NOT IN {_ORPHANS}
UNION ALL SELECT 'HEADING_LIKE_PARAGRAPH', 'warning', block_id FROM e WHERE block_type = 'paragraph' AND regexp_matches(x, '^(?:[0-9]+(?:\\.[0-9]+)*[.、]?){_SPACES}+[^\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+$')
UNION ALL SELECT 'SUSPICIOUS_WORD_SPACING', 'warning', block_id FROM e WHERE regexp_matches(text, '(?:https?://|www\\.|(?:^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])[\\p{{L}}\\p{{N}}\\p{{M}}_]+\\.){_SPACES}+[A-Za-z0-9]')
UNION ALL SELECT 'POSSIBLE_FIGURE_LABEL_SEQUENCE', 'warning', block_id FROM runs WHERE n >= 2 AND c = 1
UNION ALL SELECT 'POSSIBLE_READING_ORDER_BREAK', 'warning', block_id FROM nx WHERE np = page_start AND ntext IN {_ORPHANS} AND NOT regexp_matches(regexp_replace(text, '{_SPACES}+$', ''), '[。！？.!?]$'))"""


@query(f"WITH {AUDIT_BLOCKS_SQL} SELECT issue_code, severity, block_id FROM issues WHERE issue_code <> 'SUSPICIOUS_WORD_SPACING'")
def audit_blocks(spark: SparkSession, d: str) -> DataFrame:
    return audit.block_issues(blocks_of(spark, d)).select("issue_code", "severity", "block_id").where("issue_code <> 'SUSPICIOUS_WORD_SPACING'")


@query()
def audit_spacing(spark: SparkSession, d: str) -> DataFrame:
    return audit.block_issues(blocks_of(spark, d)).select("issue_code", "severity", "block_id").where("issue_code = 'SUSPICIOUS_WORD_SPACING'")


@query(
    f"""WITH {CHUNKS_SQL}, {BLOCKS_SQL}, issues AS (
    SELECT 'EMPTY_CHUNK' AS issue_code, chunk_id FROM c WHERE content IS NULL OR index_text IS NULL OR {trim_sql('content')} = '' OR {trim_sql('index_text')} = ''
    UNION ALL SELECT 'INVALID_PAGE_RANGE', chunk_id FROM c WHERE page_start IS NULL OR page_end IS NULL OR page_start < 1 OR page_end < page_start
    UNION ALL SELECT 'CHUNK_EXCEEDS_CONFIGURED_LIMIT', chunk_id FROM c WHERE length(index_text) > 1200
    UNION ALL (SELECT 'BROKEN_BLOCK_REFERENCE', chunk_id FROM (SELECT chunk_id, unnest(block_ids) AS x FROM c) WHERE x NOT IN (SELECT block_id FROM b) UNION SELECT 'BROKEN_BLOCK_REFERENCE', chunk_id FROM c WHERE len(block_ids) <> len(list_distinct(block_ids))))
    SELECT issue_code, chunk_id FROM issues"""
)
def audit_chunks(spark: SparkSession, d: str) -> DataFrame:
    return audit.chunk_issues(chunks_of(spark, d), blocks_of(spark, d)).select("issue_code", "chunk_id")


@query(f"WITH {AUDIT_BLOCKS_SQL} SELECT severity, count(*) AS n FROM issues WHERE issue_code <> 'SUSPICIOUS_WORD_SPACING' GROUP BY ALL")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.summary(audit.block_issues(blocks_of(spark, d)).where("issue_code <> 'SUSPICIOUS_WORD_SPACING'"))


@query()
def audit_summary_all(spark: SparkSession, d: str) -> DataFrame:
    """Issues of all codes by severity; the SQL of ``audit_summary`` leaves out SUSPICIOUS_WORD_SPACING."""
    return audit.summary(audit.block_issues(blocks_of(spark, d)))


@query()
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(blocks_of(spark, d)).select("chunk_id", "document_id", "ordinal", "page_start", "page_end", F.char_length("index_text").alias("chars"), F.array_join("block_ids", ",").alias("block_ids"))


@query()
def chunking_report(spark: SparkSession, d: str) -> DataFrame:
    b = blocks_of(spark, d)
    return chunking.report(chunking.drafts(b), b)


@query()
def chunk_pack_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Chunks over the limit that hold more than one unit or no atomic one, and body blocks in no chunk: none of either."""
    b = blocks_of(spark, d)
    return chunking.bounds(b, chunking.drafts(b))
