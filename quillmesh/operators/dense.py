"""Exact dense search by cosine, in blocks: a stated set of query vectors against all vectors, and the vector table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.filters import SearchFilters
from quillmesh.functions.ids import point_id, prefix_keys
from quillmesh.operators.lexical import ranked
from quillmesh.session import ship

#: Vectors of a block at least, numbers of a block at most where that allows more vectors, similarities held at once.
BLOCK, NUMBERS, TILE = 4096, 1 << 20, 1 << 20


def valid_vector(values: Column, dimensions: Column) -> Column:
    """Length as stated, all values finite, not all zero."""
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(values) == dimensions) & finite & F.exists(values, lambda x: x != 0), F.lit(False))


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, filters: SearchFilters | None = None, block: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k vectors (chunk_id, space, values) of the same space most like each query vector
    (query_id, space, values). Both sides are divided into blocks by hash; each pair of blocks is one matrix product, in tiles of queries, whose
    k best per query go on. A side is copied once for each block of the other, so a block is of ``block`` vectors or about 8 MB. Filters are
    applied before the search."""
    ship(vectors.sparkSession)
    if filters is not None:
        vectors = vectors.where(filters.predicate())
    rows = F.lit(block) if block else F.greatest(F.lit(BLOCK), F.floor(NUMBERS / F.max(F.size("values"))))
    n = vectors.groupBy("space").agg(F.ceil(F.count("*") / rows).cast("int").alias("vb"))
    m = queries.groupBy("space").agg(F.ceil(F.count("*") / rows).cast("int").alias("qb"))
    size = F.broadcast(n.join(m, "space"))  # a row for each version and number of dimensions
    own = vectors.select("space", F.col("chunk_id").alias("id"), "values").join(size, "space").withColumn("v", F.pmod(F.xxhash64("id"), "vb").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    ask = queries.select("space", F.col("query_id").alias("id"), "values").join(size, "space").withColumn("q", F.pmod(F.xxhash64("id"), "qb").cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)))
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double"

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        x, y = np.stack(a["values_a"].to_list()).astype(float), np.stack(b["values_b"].to_list()).astype(float)
        x, y = (x / np.linalg.norm(x, axis=1, keepdims=True)).T, y / np.linalg.norm(y, axis=1, keepdims=True)
        parts, step = [], max(1, TILE // x.shape[1])
        for low in range(0, len(y), step):
            s = y[low : low + step] @ x
            if s.shape[1] > k:  # all that tie with the k-th go on
                least = np.round(-np.partition(-s, k - 1, axis=1)[:, k - 1 : k], 9)
                r, c = np.nonzero(np.round(s, 9) >= least)
            else:
                r, c = np.nonzero(np.ones_like(s, bool))
            parts.append((r + low, c, s[r, c]))
        r, c, score = (np.concatenate(z) for z in zip(*parts, strict=True))
        return pd.DataFrame({"query_id": b["id_b"].to_numpy()[r], "chunk_id": a["id_a"].to_numpy()[c], "score": score})

    keys = ["space", "q", "v"]

    def side(df: DataFrame, tag: str) -> DataFrame:  # new columns, as both sides may come from one table
        return df.select(*[F.col(c).alias(f"{c}_{tag}") for c in (*keys, "id", "values")])

    a, b = side(own, "a"), side(ask, "b")
    found = a.groupBy(*[f"{c}_a" for c in keys]).cogroup(b.groupBy(*[f"{c}_b" for c in keys])).applyInPandas(best, kind)
    return ranked(found, k)


def payload(records: DataFrame) -> DataFrame:
    """The stored form of records: point id, chunk fields, prefix keys, version (PRJ4)."""
    return records.select(point_id(F.col("chunk.chunk_id")).alias("point_id"), "chunk.*", prefix_keys(F.col("chunk.heading_path")).alias("heading_prefixes"), F.col("vector.values").alias("values"), "embedding_version")


#: Fields of a chunk in its stored form.
CHUNK_FIELDS = ("chunk_id", "document_id", "content", "index_text", "heading_path", "page_start", "page_end", "ordinal", "block_ids", "source_path", "content_hash", "normalization_version", "chunking_version")


def restored(stored: DataFrame) -> DataFrame:
    """Chunks from their stored form (PRJ5): a missing field is an error at once, one that is null when the rows are read."""
    missing = sorted(set(CHUNK_FIELDS) - set(stored.columns))
    if missing:
        raise ValueError(f"the stored form lacks fields of chunks: {', '.join(missing)}")

    def given(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"a stored chunk has no {c}: "), F.coalesce("chunk_id", F.lit("?"))))).alias(c)

    return stored.select(*[given(c) for c in CHUNK_FIELDS])


def stored_predicate(filters: SearchFilters) -> Column:
    """Search filters on the stored form: the heading prefix is looked up among the keys of prefixes (FIL2)."""
    from dataclasses import replace

    rest = replace(filters, heading_prefix=None).predicate()
    if filters.heading_prefix is None:
        return rest
    key = F.to_json(F.array(*map(F.lit, filters.heading_prefix)))
    return rest & F.array_contains("heading_prefixes", key)


def upsert(existing: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """The table after new rows replaced those of the same key (SNK10): of several new rows the last, by content, wins."""
    last = Window.partitionBy(key).orderBy(F.xxhash64(*[F.col(c) for c in new.columns]).desc())
    once = new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    return existing.join(once, key, "left_anti").unionByName(once)


def version_conflicts(records: DataFrame) -> DataFrame:
    """(embedding_versions, dimensions) if an upsert would mix several (AGG13); no row otherwise."""
    return records.agg(F.count_distinct("embedding_version").alias("embedding_versions"), F.count_distinct("vector.dimensions").alias("dimensions")).where("embedding_versions > 1 or dimensions > 1")
