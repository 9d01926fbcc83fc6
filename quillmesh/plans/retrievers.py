"""The registry of retrievers and the agent tool over it."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.filters import SearchFilters
from quillmesh.operators import dense, fusion, lexical

NAMES = ("bm25", "dense", "hybrid", "rerank")
MOST_QUERY_CHARS, MOST_HITS, MOST_FETCH = 500, 10, 200


@dataclass(frozen=True)
class Retrievers:
    """Built once for a corpus: a lexical index, vectors (chunk_id, space, values) with the columns of filters, and a function
    from queries (query_id, query) to query vectors (query_id, space, values)."""

    index: lexical.LexicalIndex
    vectors: DataFrame | None = None
    embed: Any = None
    ties: tuple[str, ...] = ("document_id", "ordinal", "chunk_id")  # the order of the corpus

    def search(self, name: str, queries: DataFrame, k: int = 5, filters: SearchFilters | None = None, fetch_k: int = fusion.FETCH_K, rrf_k: int = fusion.RRF_K, leg_k: int = fusion.LEG_K) -> DataFrame:
        if name not in NAMES:
            raise ValueError(f"unknown retriever {name}")
        if not 1 <= k <= fetch_k <= MOST_FETCH and name == "rerank" or k < 1 or rrf_k < 1 or not 1 <= leg_k <= MOST_FETCH:
            raise ValueError(f"sizes must be positive, at most {MOST_FETCH}, and as many fetched as returned")
        if name == "bm25":
            return lexical.search(self.index, queries, k, filters, self.ties)
        if self.vectors is None or self.embed is None:
            raise ValueError(f"{name} needs vectors and an embedding function")
        if name == "dense":
            return dense.search(self.vectors, self.embed(queries), k, filters)
        if name == "hybrid":
            legs = lexical.search(self.index, queries, leg_k, filters, self.ties), dense.search(self.vectors, self.embed(queries), leg_k, filters)
            return fusion.reciprocal_ranks(*legs, k=k, rrf_k=rrf_k, leg_k=leg_k)
        return fusion.rerank(self.search("hybrid", queries, fetch_k, filters, rrf_k=rrf_k, leg_k=leg_k), queries, self.index.chunks, k)

    def ready(self) -> bool:
        """Whether the corpus has chunks, and vectors if it is to have any."""
        return not self.index.chunks.isEmpty() and (self.vectors is None or not self.vectors.isEmpty())


class SearchTool:
    """The agent tool: checked arguments in, a dictionary out; errors are results, not exceptions."""

    def __init__(self, retrievers: Retrievers, allowed: tuple[str, ...] = NAMES) -> None:
        self.retrievers, self.allowed = retrievers, allowed

    def schema(self) -> dict:
        string_list = {"type": "array", "items": {"type": "string"}}
        fields = {"query": {"type": "string", "maxLength": MOST_QUERY_CHARS}, "retriever": {"type": "string", "enum": list(self.allowed)}, "top_k": {"type": "integer", "minimum": 1, "maximum": MOST_HITS}, "document_ids": string_list, "heading_prefix": string_list, "page_start": {"type": "integer", "minimum": 1}, "page_end": {"type": "integer", "minimum": 1}}
        return {"type": "function", "function": {"name": "search_knowledge", "description": "Search the knowledge base.", "parameters": {"type": "object", "properties": fields, "required": ["query"], "additionalProperties": False}}}

    def checked(self, raw: dict) -> dict:
        known = set(self.schema()["function"]["parameters"]["properties"])
        if set(raw) - known:
            raise ValueError(f"unknown argument {sorted(set(raw) - known)[0]}")
        query, k, name = raw.get("query"), raw.get("top_k", 5), raw.get("retriever", self.allowed[0])
        if not isinstance(query, str) or not query.strip() or len(query) > MOST_QUERY_CHARS:
            raise ValueError("query must be a text of 1 to 500 characters")
        if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= MOST_HITS:
            raise ValueError("top_k must be from 1 to 10")
        if name not in self.allowed:
            raise ValueError(f"retriever {name} is not allowed")
        lists = {n: tuple(raw[n]) if raw.get(n) is not None else None for n in ("document_ids", "heading_prefix")}
        return {"query": query, "top_k": k, "retriever": name, "filters": SearchFilters(**lists, page_start=raw.get("page_start"), page_end=raw.get("page_end"))}

    def execute(self, raw: dict | str) -> dict:
        try:
            args = self.checked(json.loads(raw) if isinstance(raw, str) else raw)
            spark = self.retrievers.index.chunks.sparkSession
            queries = spark.createDataFrame([("q", args["query"])], "query_id string, query string")
            hits = self.retrievers.search(args["retriever"], queries, args["top_k"], args["filters"])
            rows = hits.join(self.retrievers.index.chunks, "chunk_id").select("rank", "score", "chunk_id", "document_id", "heading_path", "page_start", "page_end", "content").orderBy("rank").collect()
            counts = lexical.candidate_counts(self.retrievers.index.chunks, queries.withColumn("filters", filters_column(args["filters"]))).first()
            return {"success": True, "retriever": args["retriever"], "candidate_count": counts.candidate_count, "hits": [r.asDict() for r in rows]}
        except Exception as e:  # noqa: BLE001
            return {"success": False, "error": f"{type(e).__name__}: {str(e)[:300]}"}


def filters_column(f: SearchFilters) -> Column:
    """Filters as the struct that tables of cases have."""
    def strings(values: tuple[str, ...] | None) -> Column:
        return F.lit(None).cast("array<string>") if values is None else F.array(*map(F.lit, values))

    pages = [F.lit(v).cast("bigint").alias(n) for n, v in (("page_start", f.page_start), ("page_end", f.page_end))]
    return F.struct(strings(f.document_ids).alias("document_ids"), strings(f.heading_prefix).alias("heading_prefix"), *pages)


def hits_with_chunks(hits: DataFrame, chunks: DataFrame, source_path: bool = False) -> DataFrame:
    """Hits with what a caller may see (PRJ1-PRJ3); the source path only if asked for."""
    h = F.col("heading_path")
    pages = F.when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(F.concat("page_start", F.lit("-"), "page_end"))
    at = hits.join(chunks, "chunk_id").withColumn("chapter", F.try_element_at(h, F.lit(1))).withColumn("section", F.try_element_at(h, F.lit(-1))).withColumn("pages", pages)
    return at.select("query_id", "rank", "score", "chunk_id", "document_id", "chapter", "section", "pages", "content", *(["source_path"] if source_path else []))
