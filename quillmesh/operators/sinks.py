"""Sinks: JSON lines, Markdown, reports, the vector table. An existing target is refused unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.filters import SearchFilters
from quillmesh.operators import dense


def jsonl(df: DataFrame, path: str, *order: str, single: bool = False) -> None:
    """One compact JSON object a line; ``single`` for artifacts that must be one file."""
    out = df.orderBy(*order) if order else df
    (out.coalesce(1) if single else out).select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def report(row: DataFrame, path: str) -> None:
    jsonl(row, path, single=True)


def by_section(df: DataFrame, path: str, key: str = "section_id") -> None:
    """One folder for each section."""
    df.write.mode("errorifexists").partitionBy(key).json(path)


def block_markdown() -> Column:
    """A block's human form by its type."""
    level = F.least(F.greatest(F.size("heading_path"), F.lit(1)), F.lit(6))
    kind = F.col("block_type")
    body = (
        F.when(kind.isin("document_title", "section_heading"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("text")))
        .when(kind == "list_item", F.concat(F.lit("- "), F.col("text")))
        .when(kind == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
        .when(kind == "figure_caption", F.concat(F.coalesce(F.concat(F.lit("!["), F.col("text"), F.lit("]("), F.col("image_path"), F.lit(")\n")), F.lit("")), F.lit("*"), F.col("text"), F.lit("*")))
        .when(kind == "figure_label", F.concat(F.lit("<!-- not indexed: "), F.col("text"), F.lit(" -->")))
        .otherwise(F.col("text"))
    )
    meta = F.format_string("<!-- block %s pages %d-%d -->", F.col("block_id"), F.col("page_start"), F.col("page_end"))
    return F.concat(meta, F.lit("\n"), body)


def chunk_markdown() -> Column:
    meta = F.format_string("## %d. %s\n\npages %d-%d, %d characters", F.col("ordinal"), F.array_join("heading_path", " > "), F.col("page_start"), F.col("page_end"), F.char_length("index_text"))
    return F.concat(meta, F.lit("\n\n"), F.col("content"), F.lit("\n\n---"))


def markdown(df: DataFrame, rendered: Column, path: str, *order: str) -> None:
    df.orderBy(*order).coalesce(1).select(rendered.alias("value")).write.mode("errorifexists").text(path, lineSep="\n\n")


def hits_text() -> Column:
    """The human form of a hit."""
    return F.format_string("%d. [%.4f] %s (p. %s-%s)\n%s", F.col("rank"), F.col("score"), F.array_join("heading_path", " > "), F.col("page_start"), F.col("page_end"), F.substring("content", 1, 200))


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], dimensions: int, version: str, batch: int = 8) -> DataFrame:
    """Vector records of chunks by an embedding function that runs in the workers; wrong numbers or sizes are an error."""
    schema = "chunk_id string, values array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[list[float]] = []
            for i in range(0, len(f), batch):
                part = f["index_text"].iloc[i : i + batch].tolist()
                got = embed(part)
                if len(got) != len(part) or any(len(v) != dimensions for v in got):
                    raise ValueError("the embedding source gave other numbers of vectors or dimensions")
                out += [[float(x) for x in v] for v in got]
            yield pd.DataFrame({"chunk_id": f["chunk_id"].tolist(), "values": out})

    vectors = chunks.select("chunk_id", "index_text").mapInPandas(run, schema)
    chunk = F.struct(*[F.col(c) for c in chunks.columns]).alias("chunk")
    return chunks.select("chunk_id", chunk).join(vectors, "chunk_id").select("chunk", F.struct("values", F.lit(dimensions).cast("bigint").alias("dimensions")).alias("vector"), F.lit(version).alias("embedding_version"))


class VectorTable:
    """A vector collection as a Parquet table: fixed dimensions, cosine, one version, keyed by point id. Each write is a new
    snapshot folder, so that readers of the old one are not disturbed and a lost executor can't leave half a table."""

    def __init__(self, spark: SparkSession, path: str, dimensions: int) -> None:
        self.spark, self.path, self.dimensions = spark, path.rstrip("/"), dimensions

    def _fs(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def snapshots(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(int(n[1:]) for n in names if n.startswith("s") and n[1:].isdigit() and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        found = self.snapshots()
        return self.spark.read.parquet(f"{self.path}/s{found[-1]}") if found else None

    def create(self) -> bool:
        """Makes sure that the table can take vectors of its dimensions: nothing to do for a new one, an error if the present one
        has others or several versions (SNK12). True if it is new."""
        rows = self.read()
        if rows is None:
            return True
        facts = rows.agg(F.count_if(F.size("values") != self.dimensions).alias("other"), F.count_distinct("embedding_version").alias("versions")).first()
        if facts.other:
            raise ValueError(f"the table has {facts.other} vectors of other dimensions than {self.dimensions}")
        if facts.versions > 1:
            raise ValueError("the table has several embedding versions")
        return False

    def search(self, queries: DataFrame, k: int = 5, filters: SearchFilters | None = None) -> DataFrame:
        """The k nearest points of each query vector (query_id, values), chunks restored: (query_id, rank, score, chunk fields)."""
        rows = self.read()
        if rows is None:
            raise ValueError("the table has no vectors")
        if filters is not None:
            rows = rows.where(dense.stored_predicate(filters))
        space = F.lit("all").alias("space")
        hits = dense.search(rows.select("chunk_id", space, "values"), queries.select("query_id", space, "values"), k)
        return hits.join(dense.restored(rows), "chunk_id")

    def upsert(self, records: DataFrame) -> int:
        """Writes records (chunk, vector, embedding_version); gives the number of points afterwards."""
        self.create()
        checked = records.where(dense.valid_vector(F.col("vector.values"), F.col("vector.dimensions")))
        if records.count() != checked.count() or checked.where(F.col("vector.dimensions") != self.dimensions).limit(1).count():
            raise ValueError("vectors must be finite, not zero and of the table's dimensions")
        if not dense.version_conflicts(records).isEmpty():
            raise ValueError("one write must have one embedding version")
        new = dense.payload(checked)
        old = self.read()
        out = dense.upsert(old, new) if old is not None else dense.upsert(new.limit(0), new)
        found = self.snapshots()
        target = f"{self.path}/s{found[-1] + 1 if found else 0}"
        out.write.mode("errorifexists").parquet(target)
        return self.spark.read.parquet(target).count()

    def count(self, predicate: Column | None = None) -> int:
        rows = self.read()
        return 0 if rows is None else (rows if predicate is None else rows.where(predicate)).count()
