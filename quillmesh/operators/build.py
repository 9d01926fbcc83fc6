"""Books from their layouts: normalize, chunk and audit every section in one plan, then assemble the corpus."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import audit, chunking, overlay
from quillmesh.sources import jsonl, layout

_ID = re.compile(r"[a-z0-9][a-z0-9-]*")


@dataclass(frozen=True)
class Section:
    section_id: str
    title: str
    start_page: int
    end_page: int
    include_in_index: bool = True


@dataclass(frozen=True)
class Manifest:
    """The sections of one source; they are in order and don't overlap (SRC9)."""

    schema_version: str
    book_id: str
    source_sha256: str
    source_page_count: int
    sections: tuple[Section, ...]
    public_metadata: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.schema_version or not _ID.fullmatch(self.book_id) or not re.fullmatch("[A-Fa-f0-9]{64}", self.source_sha256) or self.source_page_count < 1:
            raise ValueError("the manifest's version, id, hash or page count is not valid")
        if not self.sections or len({s.section_id for s in self.sections}) < len(self.sections):
            raise ValueError("a manifest needs sections with unique ids")
        before = 0
        for s in self.sections:
            if not _ID.fullmatch(s.section_id) or not s.title or not before < s.start_page <= s.end_page <= self.source_page_count:
                raise ValueError(f"section {s.section_id} is out of order, overlaps or leaves the source")
            before = s.end_page

    def selected(self, wanted: list[str] | None = None) -> list[Section]:
        """The sections asked for, all if none are named; an unknown id is an error (FIL11)."""
        unknown = sorted(set(wanted or ()) - {s.section_id for s in self.sections})
        if unknown:
            raise ValueError(f"unknown section {unknown[0]}")
        return [s for s in self.sections if wanted is None or s.section_id in wanted]


def read_manifest(text: str) -> Manifest:
    """A manifest from its JSON; unknown and missing fields are errors."""
    raw = json.loads(text)
    names = set(Manifest.__dataclass_fields__)
    if set(raw) - names or names - {"public_metadata"} - set(raw):
        raise ValueError(f"unknown or missing fields of the manifest: {sorted(set(raw) ^ (names - {'public_metadata'}))}")
    return Manifest(**(raw | {"sections": tuple(Section(**s) for s in raw["sections"])}))


def check_source(spark, path: str, manifest: Manifest) -> None:  # noqa: ANN001
    """The source file must have the hash of the manifest."""
    found = jsonl.file_hashes(spark, path).first()
    if found is None or found.document_id != f"sha256:{manifest.source_sha256.lower()}":
        raise ValueError("the source has another hash than the manifest says")


@dataclass(frozen=True)
class Built:
    """Tables with a column section_id: blocks, chunks, issues, and for each section its counts and whether it passed."""

    blocks: DataFrame
    chunks: DataFrame
    issues: DataFrame
    results: DataFrame


def sections_of(layouts: DataFrame, manifest: Manifest, wanted: list[str] | None = None, overlays: dict[str, list[overlay.Correction]] | None = None, config: chunking.ChunkingConfig = chunking.ChunkingConfig(), version: str = "1.1.0") -> Built:
    """The sections asked for of layouts (section_id, source_path, pages, texts, pictures), all in one plan (T22-T24). Each section is a
    document of its own while it is normalized, chunked and audited; ids are those of the source. ``overlays`` are by section."""
    names = [s.section_id for s in manifest.selected(wanted)]
    source = f"sha256:{manifest.source_sha256.lower()}"
    docs = layouts.where(F.col("section_id").isin(*names)).withColumn("document_id", F.col("section_id")).withColumn("identity", F.lit(source))
    blocks = layout.normalized(docs, version, {k: v for k, v in (overlays or {}).items() if k in names}).persist(StorageLevel.MEMORY_AND_DISK)
    chunks = chunking.chunks(blocks, config).persist(StorageLevel.MEMORY_AND_DISK)
    counted = layout.report(docs, blocks)
    ratios = counted.select("document_id", "short_fragment_ratio", F.size("source_pages").alias("source_pages"), F.size("review_pages").alias("pages_requiring_review"))
    issues = audit.full(audit.Artifacts(blocks, chunks, normalization_report=ratios), audit.AuditConfig(max_chars=config.max_chars)).persist(StorageLevel.MEMORY_AND_DISK)
    expected = layouts.sparkSession.createDataFrame([(s.section_id, i) for i, s in enumerate(manifest.sections) if s.section_id in names], "document_id string, section_no int")
    n = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    results = expected.join(n, "document_id", "left").join(audit.report(issues), "document_id", "left").select("document_id", "section_no", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunk_count", "error_count", "warning_count")])
    results = results.withColumn("passed", (F.col("error_count") == 0) & (F.col("chunk_count") > 0))

    def named(df: DataFrame) -> DataFrame:
        out = df.withColumnRenamed("document_id", "section_id").drop("identity")
        return out.withColumn("document_id", F.lit(source))

    return Built(named(blocks), named(chunks), named(issues), named(results))


def corpus_of(built: Built, manifest: Manifest) -> tuple[DataFrame, DataFrame]:
    """(chunks, manifest row) of the whole corpus (T25, SNK9): every section must be there and have passed; a chunk id in two sections and an
    empty corpus are errors. The few results of sections are looked at first; ordinals are counted on over the sections."""
    rows = {r.section_id: r for r in built.results.collect()}  # one row a section
    if set(rows) != {s.section_id for s in manifest.sections}:
        raise ValueError("a corpus needs a result of every section of its manifest")
    if any(not r.passed for r in rows.values()):
        raise ValueError("the audit found errors; no corpus is assembled")
    included = [s.section_id for s in manifest.sections if s.include_in_index]
    before, offsets = 0, []
    for name in included:
        offsets.append((name, before))
        before += rows[name].chunk_count
    if not before:
        raise ValueError("the manifest selects no chunks")
    spark = built.chunks.sparkSession
    at = built.chunks.join(F.broadcast(spark.createDataFrame(offsets, "section_id string, before bigint")), "section_id")  # one row a section
    if not at.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a chunk id stands in several sections")
    chunks = at.withColumn("ordinal", F.col("ordinal") + F.col("before")).drop("before")
    facts = {
        "schema_version": "1.0", "book_id": manifest.book_id, "source_sha256": manifest.source_sha256.lower(), "source_page_count": manifest.source_page_count, "public_metadata": manifest.public_metadata,
        "included_sections": [{"section_id": s.section_id, "title": s.title, "start_page": s.start_page, "end_page": s.end_page, "include_in_index": s.include_in_index, "chunk_count": rows[s.section_id].chunk_count, "warning_count": rows[s.section_id].warning_count} for s in manifest.sections],
        "indexed_chunk_count": before,
    }
    return chunks, spark.createDataFrame([(json.dumps(facts, ensure_ascii=False),)], "manifest string")
