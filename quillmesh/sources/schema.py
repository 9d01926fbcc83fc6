"""Schemas of the records and their contracts as violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.text import is_blank

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRINGS = T.ArrayType(S)
#: The types of blocks.
BLOCK_TYPES = ("document_title", "section_heading", "paragraph", "list_item", "figure_caption", "table", "code", "equation", "figure_label")


def fields(required: list[tuple[str, T.DataType]], optional: list[tuple[str, T.DataType]] = []) -> T.StructType:  # noqa: B006
    return T.StructType([T.StructField(n, t, False) for n, t in required] + [T.StructField(n, t, True) for n, t in optional])


BLOCK = fields(
    [("block_id", S), ("document_id", S), ("text", S), ("block_type", S), ("heading_path", STRINGS), ("page_start", L), ("page_end", L), ("ordinal", L), ("source_path", S), ("normalization_version", S)],
    [("image_path", S)],
)
CHUNK = fields(
    [
        ("chunk_id", S), ("document_id", S), ("content", S), ("index_text", S), ("heading_path", STRINGS), ("page_start", L), ("page_end", L), ("ordinal", L), ("block_ids", STRINGS), ("source_path", S),
        ("content_hash", S), ("normalization_version", S), ("chunking_version", S),
    ]
)
FILTERS = fields([], [("document_ids", STRINGS), ("heading_prefix", STRINGS), ("page_start", L), ("page_end", L)])
CASE = fields([("case_id", S), ("query", S), ("relevant_chunk_ids", STRINGS)], [("filters", FILTERS)])
VECTOR = fields([("values", T.ArrayType(D)), ("dimensions", L)])
SECTION = fields([("section_id", S), ("title", S), ("start_page", L), ("end_page", L)], [("include_in_index", B)])
MANIFEST = fields([("schema_version", S), ("book_id", S), ("source_sha256", S), ("source_page_count", L), ("sections", T.ArrayType(SECTION))], [("public_metadata", T.MapType(S, S))])
_REF = T.StructType([T.StructField("$ref", S)])
_BOX = fields([], [("l", D), ("t", D), ("r", D), ("b", D), ("coord_origin", S)])
LAYOUT = fields(
    [],
    [
        ("pages", T.MapType(S, fields([], [("page_no", L), ("size", fields([], [("width", D), ("height", D)]))]))),
        ("texts", T.ArrayType(fields([], [("self_ref", S), ("parent", _REF), ("content_layer", S), ("label", S), ("prov", T.ArrayType(fields([], [("page_no", L), ("bbox", _BOX)]))), ("text", S)]))),
        ("pictures", T.ArrayType(fields([], [("image", fields([], [("uri", S)])), ("captions", T.ArrayType(_REF))]))),
    ],
)


def broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with ``violations``, the names of the rules they break; a rule that is null counts as broken."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("violations", names).where(F.size("violations") > 0)


def _filled(*names: str) -> Column:
    return reduce(Column.__and__, [~is_blank(F.col(n)) for n in names])


def block_violations(blocks: DataFrame) -> DataFrame:
    path, kind = F.col("heading_path"), F.col("block_type")
    image = F.col("image_path")
    return broken(
        blocks,
        {
            "blank": _filled("block_id", "document_id", "text", "source_path", "normalization_version"),
            "type": kind.isin(*BLOCK_TYPES),
            "pages": (F.col("page_start") >= 1) & (F.col("page_end") >= F.col("page_start")),
            "ordinal": F.col("ordinal") >= 1,
            "heading": ~kind.isin("document_title", "section_heading") | (F.try_element_at(path, F.lit(-1)) == F.col("text")),
            "image": image.isNull() | ~(image.startswith("/") | image.contains("\\") | image.rlike(r"(^|/)\.\.(/|$)") | image.rlike("^[A-Za-z]:")),
        },
    )


def chunk_violations(chunks: DataFrame) -> DataFrame:
    return broken(
        chunks,
        {
            "blank": _filled("chunk_id", "document_id", "content", "index_text", "source_path", "content_hash", "normalization_version", "chunking_version"),
            "path": F.size("heading_path") > 0,
            "block_ids": (F.size("block_ids") > 0) & (F.size("block_ids") == F.size(F.array_distinct("block_ids"))),
            "pages": (F.col("page_start") >= 1) & (F.col("page_end") >= F.col("page_start")),
            "ordinal": F.col("ordinal") >= 1,
        },
    )


def result_violations(hits: DataFrame) -> DataFrame:
    """Queries whose hits aren't ranked 1..n without repeats and with finite scores."""
    by = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.count_distinct("rank").alias("ranks"), F.count_distinct("chunk_id").alias("chunks"), F.bool_and(~F.isnan("score") & (F.abs("score") < F.lit(float("inf")))).alias("finite"))
    return broken(by, {"ranks": (F.col("last") == F.col("n")) & (F.col("ranks") == F.col("n")), "repeats": F.col("chunks") == F.col("n"), "score": F.col("finite")})


def metric_violations(results: DataFrame) -> DataFrame:
    """Case results that don't agree with themselves."""
    rank = F.col("first_relevant_rank")
    return broken(
        results,
        {
            "range": F.col("recall_at_k").between(0, 1) & F.col("reciprocal_rank").between(0, 1),
            "rank": F.abs(F.col("reciprocal_rank") - F.coalesce(1.0 / rank, F.lit(0.0))) <= 1e-12,
            "hit": F.col("hit_at_k") == rank.isNotNull(),
        },
    )
