"""The registered queries of this subpackage, by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import encode, language, lookalike, mixing, pieces, scans, sentences, terms, vectors
from quillmesh.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_column(table(spark, d, "documents", "doc_id", "text"))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def _limited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    blocks = table(spark, d, "normalized_blocks", "block_id", "text")
    chunks = table(spark, d, "knowledge_chunks", "chunk_id", "content", "index_text")
    texts = pieces.fields((blocks, "block_id", "text", "block_text"), (chunks, "chunk_id", "content", "chunk_content"), (chunks, "chunk_id", "index_text", "chunk_index_text"))
    return texts, table(spark, d, "size_limits")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.cut_kinds(*_limited(spark, d))


@query
def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split(*_limited(spark, d))


@query
def p6_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of ``p6_pieces`` again, by ranges of 2 KB, so that most texts are stitched; per record its characters as the pieces cover them,
    their gaps and their breaches of the limit."""
    texts, limits = _limited(spark, d)
    return pieces.coverage(pieces.split(texts, limits, range_bytes=2048), limits)


def _index_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_chunks").selectExpr("chunk_id as record_id", "index_text as text")


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "term_probes").withColumnRenamed("chunk_id", "record_id")
    return terms.distinctive(probes, _index_texts(spark, d))


@query
def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return terms.scores(_index_texts(spark, d)).withColumnRenamed("record_id", "chunk_id")


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.close_pairs(table(spark, d, "vector_records"))


@query
def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar(table(spark, d, "vector_records"))


HUNDREDTH = "vec_id % 100 = 0"  # the queries of a search that is checked against all rows


@query
def p1_exact(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest_exactly(table(spark, d, "vector_records"), HUNDREDTH).select("vec_a", "vec_b")


@query
def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "vector_records")
    return vectors.recall(vectors.similar(records), vectors.nearest_exactly(records, HUNDREDTH))


def _visible(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "normalized_blocks").selectExpr("'block' as record_kind", "block_id as id", "text")
    return blocks.unionByName(table(spark, d, "knowledge_chunks").selectExpr("'chunk' as record_kind", "chunk_id as id", "index_text as text"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(_visible(spark, d))


@query
def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.classes(_visible(spark, d))


@query
def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each usable vector with its class of exact copies and the number of close partners outside it."""
    return vectors.linked(table(spark, d, "vector_records"))


@query
def p3_normalized(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalized(_visible(spark, d))


def _sentence_texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    blocks = table(spark, d, "normalized_blocks").selectExpr("block_id as id", "text")
    return blocks, table(spark, d, "knowledge_chunks").selectExpr("chunk_id as id", "content as text")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.probed(table(spark, d, "sentence_probes"), *_sentence_texts(spark, d))


@query
def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    blocks, chunks = _sentence_texts(spark, d)
    both = blocks.selectExpr("concat('block\\0', id) as key", "text").unionByName(chunks.selectExpr("concat('chunk\\0', id) as key", "text"))
    return _sentences(sentences.once_each(sentences.sentence_table(both)))


@query
def p5_chunked(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of ``p5_sentences`` again, by a prefix scan over chunks of 2 KB, so that long texts have several."""
    blocks, chunks = _sentence_texts(spark, d)
    both = blocks.selectExpr("concat('block\\0', id) as key", "text").unionByName(chunks.selectExpr("concat('chunk\\0', id) as key", "text"))
    return _sentences(sentences.once_each(sentences.sentence_table(both, chunk=2048)))


def _sentences(found: DataFrame) -> DataFrame:
    return found.selectExpr("split_part(key, '\\0', 1) as record_kind", "split_part(key, '\\0', 2) as record_id", "posexplode(ends) as (n, end_pos)").withColumn("n", F.col("n") + 1)


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.label_cases(table(spark, d, "documents"))


@query
def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "documents"))


@query
def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(table(spark, d, "documents"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.findings(table(spark, d, "normalized_blocks"))


@query
def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(table(spark, d, "normalized_blocks"))
