"""Queries of retrieval: terms, BM25, dense, fusion, rerank, evaluation, vectors."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import ids, text
from quillmesh.operators import dense, evaluation, fusion, lexical
from quillmesh.plans.register import query
from quillmesh.sources.tables import once, table

_WIDE, _NARROW = text._WIDE, text._NARROW
CHUNKS_SQL = "c AS (SELECT DISTINCT ON (chunk_id) * FROM knowledge_chunks WHERE chunk_id IS NOT NULL ORDER BY chunk_id, ingested_at)"
CASES_SQL = "q AS (SELECT DISTINCT ON (case_id) * FROM evaluation_cases WHERE query IS NOT NULL ORDER BY case_id)"


def tokens_sql(col: str) -> str:
    return rf"regexp_extract_all(replace(lower(translate(coalesce({col}, ''), '{_WIDE}', '{_NARROW}')), 'ß', 'ss'), '\b[0-9]+(?:\.[0-9]+)*\b|[a-z0-9]+|[\p{{L}}\p{{N}}]')"


POSTINGS_SQL = f"""{CHUNKS_SQL},
tok AS (SELECT chunk_id, unnest({tokens_sql("index_text")}) AS term FROM c),
post AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT chunk_id, count(*) AS dl FROM tok GROUP BY ALL),
corpus AS (SELECT (SELECT count(*) FROM c) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM c) AS avgdl),
df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY ALL),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, corpus),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
BM25_SQL = f"""{POSTINGS_SQL}, {CASES_SQL},
qt AS (SELECT case_id, term, count(*) AS qtf FROM (SELECT case_id, unnest({tokens_sql("query")}) AS term FROM q) GROUP BY ALL),
bm AS (SELECT case_id AS query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id), corpus GROUP BY ALL)"""


def ranked_sql(source: str, k: int) -> str:
    return f"SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {source}) WHERE rank <= {k}"


FILTER_SQL = """(f IS NULL OR ((f.document_ids IS NULL OR list_contains(f.document_ids, document_id)) AND (f.heading_prefix IS NULL OR heading_path[1:len(f.heading_prefix)] = f.heading_prefix)
 AND (f.page_start IS NULL OR page_end >= f.page_start) AND (f.page_end IS NULL OR page_start <= f.page_end)))"""


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "knowledge_chunks"), "chunk_id")


def cases_of(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.clean(table(spark, d, "evaluation_cases"))


def questions(cases: DataFrame, filters: bool = False) -> DataFrame:
    return cases.select(F.col("case_id").alias("query_id"), "query", *(["filters"] if filters else []))


def rounded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {POSTINGS_SQL} SELECT term, df, cf FROM df")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_stats(lexical.posted(chunks_of(spark, d)))


@query(f"WITH {POSTINGS_SQL} SELECT chunk_id, dl FROM dl")
def document_lengths(spark: SparkSession, d: str) -> DataFrame:
    return lexical.posted(chunks_of(spark, d)).groupBy("chunk_id").agg(F.first("dl").alias("dl"))


@query(f"WITH {POSTINGS_SQL} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build(chunks_of(spark, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({ranked_sql('bm', 5)})")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lexical.search(lexical.build(chunks_of(spark, d)), questions(cases_of(spark, d)), 5))


@query(
    f"""WITH {BM25_SQL}, fb AS (SELECT bm.* FROM bm JOIN c USING (chunk_id) JOIN (SELECT case_id AS query_id, filters AS f FROM q) USING (query_id) WHERE {FILTER_SQL})
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({ranked_sql("fb", 5)})"""
)
def bm25_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lexical.search(lexical.build(chunks_of(spark, d)), questions(cases_of(spark, d), filters=True), 5))


@query(f"WITH {CHUNKS_SQL}, {CASES_SQL}, f AS (SELECT case_id AS query_id, filters AS f FROM q) SELECT query_id, (SELECT count(*) FROM c WHERE {FILTER_SQL}) AS candidate_count FROM f")
def filtered_count(spark: SparkSession, d: str) -> DataFrame:
    return lexical.candidate_counts(chunks_of(spark, d), questions(cases_of(spark, d), filters=True))


EVAL_SQL = f"""WITH {BM25_SQL}, hits AS ({ranked_sql("bm", 5)}),
rel AS (SELECT case_id, list_distinct(relevant_chunk_ids) AS ids FROM q),
m AS (SELECT case_id, min(rank) AS first_relevant_rank, count(DISTINCT chunk_id) AS n FROM (SELECT case_id, unnest(ids) AS chunk_id FROM rel) JOIN (SELECT query_id AS case_id, chunk_id, rank FROM hits) USING (case_id, chunk_id) GROUP BY ALL),
res AS (SELECT case_id, first_relevant_rank, n IS NOT NULL AS hit_at_k, coalesce(n, 0) / greatest(len(ids), 1) AS recall_at_k, coalesce(1.0 / first_relevant_rank, 0.0)::DOUBLE AS reciprocal_rank FROM rel LEFT JOIN m USING (case_id))"""


@query(f"{EVAL_SQL} SELECT case_id, first_relevant_rank, hit_at_k, round(recall_at_k, 9) AS recall_at_k, round(reciprocal_rank, 9) AS reciprocal_rank FROM res")
def eval_cases(spark: SparkSession, d: str) -> DataFrame:
    cases = cases_of(spark, d)
    hits = lexical.search(lexical.build(chunks_of(spark, d)), questions(cases), 5)
    return evaluation.case_results(cases, hits).withColumns({c: F.round(c, 9) for c in ("recall_at_k", "reciprocal_rank")})


@query(f"{EVAL_SQL} SELECT count(*) AS case_count, round(avg(hit_at_k::INT), 9) AS hit_rate_at_k, round(avg(recall_at_k), 9) AS mean_recall_at_k, round(avg(reciprocal_rank), 9) AS mrr FROM res")
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    cases = cases_of(spark, d)
    hits = lexical.search(lexical.build(chunks_of(spark, d)), questions(cases), 5)
    return evaluation.report(evaluation.case_results(cases, hits)).select("case_count", *[F.round(c, 9).alias(c) for c in ("hit_rate_at_k", "mean_recall_at_k", "mrr")])


# ---------------------------------------------------------------- vectors

VECTORS_SQL = """v AS (SELECT DISTINCT ON (vec_id) vec_id, chunk, vector.values AS x, coalesce(embedding_version, '') || '|' || vector.dimensions AS space FROM vector_records
 WHERE vec_id IS NOT NULL AND len(vector.values) = vector.dimensions AND len(list_filter(vector.values, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector.values, lambda x: x <> 0)) > 0 ORDER BY vec_id, ingested_at)"""


def vectors_of(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vector_records").where(dense.valid_vector(F.col("vector.values"), F.col("vector.dimensions")))
    space = F.concat(F.coalesce("embedding_version", F.lit("")), F.lit("|"), F.col("vector.dimensions"))
    return once(rows, "vec_id").select("vec_id", "chunk", F.col("vector.values").alias("values"), space.alias("space"))


@query(
    f"""WITH {VECTORS_SQL}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_cosine_similarity(a.x, b.x) AS score FROM v a JOIN v b USING (space) WHERE a.vec_id % 100 = 0)
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({ranked_sql("s", 5)})"""
)
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors_of(spark, d).select(F.col("vec_id").alias("chunk_id"), "space", "values")
    return rounded(dense.search(v, v.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), 5))


@query(
    f"""WITH {VECTORS_SQL}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_cosine_similarity(a.x, b.x) AS score FROM v a JOIN v b USING (space) WHERE a.vec_id % 100 = 0 AND b.chunk.page_end >= 5 AND b.chunk.page_start <= 15)
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({ranked_sql("s", 5)})"""
)
def dense_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    from quillmesh.functions.filters import SearchFilters

    v = vectors_of(spark, d)
    ask = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "space", "values")
    own = v.where(SearchFilters(page_start=5, page_end=15).predicate("chunk")).select(F.col("vec_id").alias("chunk_id"), "space", "values")
    return rounded(dense.search(own, ask, 5))


@query(f"WITH {VECTORS_SQL} SELECT space, count(*) AS vectors, round(min(sqrt(list_dot_product(x, x))), 6) AS norm_min, round(max(sqrt(list_dot_product(x, x))), 6) AS norm_max FROM v GROUP BY ALL")
def norm_range(spark: SparkSession, d: str) -> DataFrame:
    n = vectors_of(spark, d).withColumn("n", dense.norm(F.col("values")))
    return n.groupBy("space").agg(F.count("*").alias("vectors"), F.round(F.min("n"), 6).alias("norm_min"), F.round(F.max("n"), 6).alias("norm_max"))


HYBRID_SQL = f"""{BM25_SQL}, {VECTORS_SQL}, w AS (SELECT chunk.chunk_id AS chunk_id, space, arg_min(x, vec_id) AS x FROM v WHERE space LIKE '%|64' GROUP BY ALL),
qv AS (SELECT case_id AS query_id, space, x FROM q JOIN w ON w.chunk_id = q.relevant_chunk_ids[1]),
de AS (SELECT query_id, w.chunk_id, list_cosine_similarity(qv.x, w.x) AS score FROM qv JOIN w USING (space)),
leg AS (SELECT query_id, chunk_id, rank FROM ({ranked_sql("bm", 10)}) UNION ALL SELECT query_id, chunk_id, rank FROM ({ranked_sql("de", 10)})),
rrf AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank))::DOUBLE AS score FROM leg GROUP BY ALL),
cnt AS (SELECT query_id, count(*) AS candidate_count FROM rrf GROUP BY ALL)"""


def hybrid(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits, queries and chunks (chunk_id, words, heading_path) of the hybrid search; a case's query vector is that of its first relevant chunk. What
    several branches read is persisted: terms and headings, cases, and vectors, laid out by chunk so that they meet the cases without another shuffle."""
    chunks = chunks_of(spark, d).select("chunk_id", lexical.joined(text.tokens(F.col("index_text"))).alias("words"), "heading_path").persist(StorageLevel.MEMORY_AND_DISK)
    cases = cases_of(spark, d).select("case_id", "query", "relevant_chunk_ids").persist(StorageLevel.MEMORY_AND_DISK)
    v = vectors_of(spark, d).where(F.col("space").endswith("|64")).select(F.col("chunk.chunk_id").alias("chunk_id"), "space", "vec_id", "values")
    w = v.repartition("chunk_id").groupBy("chunk_id", "space").agg(F.min_by("values", "vec_id").alias("values")).persist(StorageLevel.MEMORY_AND_DISK)
    ask = cases.select(F.col("case_id").alias("query_id"), F.try_element_at("relevant_chunk_ids", F.lit(1)).alias("chunk_id")).join(w, "chunk_id").select("query_id", "space", "values")
    legs = lexical.search(lexical.build(chunks, words="words"), questions(cases), fusion.LEG_K), dense.search(w, ask, fusion.LEG_K)
    return fusion.reciprocal_ranks(*legs, k=k), questions(cases), chunks


@query(f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, rank, candidate_count FROM ({ranked_sql('rrf', 5)}) JOIN cnt USING (query_id)")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d, 5)[0].select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "candidate_count")


@query(
    f"""WITH {HYBRID_SQL}, base AS ({ranked_sql("rrf", 20)}),
    t AS (SELECT query_id, chunk_id, score, list_distinct({tokens_sql("q.query")}) AS qt, list_distinct({tokens_sql("c.index_text")}) AS ct, list_distinct({tokens_sql("array_to_string(c.heading_path, ' ')")}) AS ht FROM base JOIN q ON case_id = query_id JOIN c USING (chunk_id)),
    r AS (SELECT query_id, chunk_id, score + len(list_intersect(qt, ct)) / len(qt) + len(list_intersect(qt, ht)) / len(qt) AS score FROM t WHERE len(qt) > 0)
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({ranked_sql("r", 5)})"""
)
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    hits, queries, chunks = hybrid(spark, d, fusion.FETCH_K)
    return rounded(fusion.rerank(hits, queries, chunks, 5))


# ---------------------------------------------------------------- cases and projections


@query(f"WITH {CHUNKS_SQL}, {CASES_SQL} SELECT DISTINCT case_id, x AS chunk_id FROM (SELECT case_id, unnest(relevant_chunk_ids) AS x FROM q) WHERE NOT EXISTS (SELECT 1 FROM c WHERE chunk_id = x)")
def anti_join_refs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.unknown_relevant(cases_of(spark, d), chunks_of(spark, d))


@query(f"WITH {CHUNKS_SQL}, {CASES_SQL} SELECT case_id, string_agg(x, ',' ORDER BY i) AS ids FROM (SELECT case_id, unnest(relevant_chunk_ids) AS x, generate_subscripts(relevant_chunk_ids, 1) AS i FROM q) WHERE EXISTS (SELECT 1 FROM c WHERE chunk_id = x) GROUP BY ALL")
def semi_join_refs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.known_only(cases_of(spark, d), chunks_of(spark, d)).select("case_id", F.array_join("relevant_chunk_ids", ",").alias("ids"))


@query(f"WITH {CHUNKS_SQL} SELECT heading_path[-1] AS query, string_agg(chunk_id, ',' ORDER BY document_id, ordinal, chunk_id) AS ids FROM c WHERE len(heading_path) > 0 GROUP BY ALL")
def case_builder(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.heading_cases(chunks_of(spark, d)).select("query", F.array_join("relevant_chunk_ids", ",").alias("ids"))


@query("SELECT case_id, count(*) AS n FROM evaluation_cases GROUP BY ALL HAVING count(*) > 1")
def duplicate_cases(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.duplicate_cases(table(spark, d, "evaluation_cases"))


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, heading_path[1] AS chapter, heading_path[-1] AS section, CASE WHEN page_start = page_end THEN page_start::VARCHAR ELSE page_start || '-' || page_end END AS pages FROM c")
def citation_projection(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("heading_path")
    pages = F.when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(F.concat("page_start", F.lit("-"), "page_end"))
    return chunks_of(spark, d).select("chunk_id", F.try_element_at(h, F.lit(1)).alias("chapter"), F.try_element_at(h, F.lit(-1)).alias("section"), pages.alias("pages"))


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, 'sha256:' || sha256(content) AS content_hash FROM c")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d).select("chunk_id", ids.content_hash(F.col("content")).alias("content_hash"))


@query(
    f"""WITH {CHUNKS_SQL} SELECT chunk_id, 'sha256:' || sha256('{{"block_ids":' || to_json(block_ids) || ',"chunking_version":' || to_json(chunking_version) || ',"content_hash":' || to_json(content_hash) || ',"document_id":' || to_json(document_id) || ',"heading_path":' || to_json(heading_path) || '}}') AS recomputed FROM c"""
)
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.col(c) for c in ("document_id", "heading_path", "block_ids", "content_hash", "chunking_version")]
    return chunks_of(spark, d).select("chunk_id", ids.chunk_id(*cols).alias("recomputed"))


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, unnest(list_transform(generate_series(1, len(heading_path)), lambda i: to_json(heading_path[1:i])::VARCHAR)) AS prefix_key FROM c")
def prefix_keys(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d).select("chunk_id", F.explode(ids.prefix_keys(F.col("heading_path"))).alias("prefix_key"))
