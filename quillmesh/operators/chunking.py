"""Blocks to size-bounded chunks: units, oversize splits, greedy packing with overlap."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import ids
from quillmesh.functions.text import CLOSERS, TERMINATORS, index_text, is_blank
from quillmesh.operators.sequences import ATOMIC, CONTROL, NOT_INDEXED, SPLITTABLE, body_groups, content_units
from quillmesh.session import ship

_END = re.compile(rf"[{re.escape(TERMINATORS)}][{re.escape(CLOSERS)}]*")
GAP = "\n\n"


@dataclass(frozen=True)
class ChunkingConfig:
    max_chars: int = 1200
    overlap_chars: int = 120
    version: str = "1.1.0"

    def __post_init__(self) -> None:
        if self.max_chars < 100 or not 0 <= self.overlap_chars < self.max_chars or not self.version.strip():
            raise ValueError("max_chars must be at least 100, overlap_chars from 0 to below it, version not blank")


def sentence_stops(text: str) -> list[int]:
    """Positions after sentences (S8): closing marks are taken in; an ASCII full stop needs white space or the end after it."""
    return [m.end() for m in _END.finditer(text) if m[0][0] != "." or m.end() == len(text) or text[m.end()].isspace()]


def split_to_budget(text: str, budget: int) -> list[str]:
    """Pieces of at most ``budget`` characters, cut after the last sentence that fits, else hard (S9). The sentence ends are found once,
    since what follows a cut doesn't change them."""
    if budget < 1:
        raise ValueError("the heading leaves no room for content")
    text = text.strip()
    stops = sentence_stops(text)
    at, out = 0, []
    while len(text) - at > budget:
        i = bisect.bisect_right(stops, at + budget) - 1
        cut = stops[i] if i >= 0 and stops[i] > at else at + budget
        if piece := text[at:cut].strip():
            out.append(piece)
        at = cut
        while at < len(text) and text[at].isspace():
            at += 1
    return [*out, text[at:]] if at < len(text) else out


def sentence_suffix(text: str, kind: str, room: int) -> str:
    """The longest run of whole sentences at the end of a splittable unit within ``room`` characters (S11), or nothing."""
    stops = sentence_stops(text)
    if kind not in SPLITTABLE or room < 1 or not stops or stops[-1] != len(text):
        return ""
    for p in stops[:-1]:
        if len(tail := text[p:].strip()) <= room:
            return tail
    return ""


@dataclass
class Unit:
    text: str
    kind: str
    block_ids: list[str]
    pages: tuple[int, int]


def joined(units: list[Unit]) -> str:
    return GAP.join(u.text for u in units)


def fitted(units: list[Unit], head: int, config: ChunkingConfig) -> tuple[list[Unit], int, int]:
    """Units with the oversized ones split (T8), and how many were split or kept whole because atomic."""
    out, splits, atomic = [], 0, 0
    for u in units:
        if head + len(GAP) + len(u.text) <= config.max_chars:
            out.append(u)
        elif u.kind in ATOMIC:
            out.append(u)
            atomic += 1
        else:
            out += [Unit(t, u.kind, u.block_ids, u.pages) for t in split_to_budget(u.text, config.max_chars - head - len(GAP))]
            splits += 1
    return out, splits, atomic


def overlap_of(primary: list[Unit], follower: Unit, head: int, config: ChunkingConfig) -> list[Unit]:
    """What the next chunk repeats of this one (T10): whole units from the end, then once the sentences of one more."""
    room = min(config.overlap_chars, config.max_chars - head - len(GAP) - len(follower.text) - len(GAP))
    picked: list[Unit] = []
    if room < 1:
        return picked
    for u in reversed(primary):
        if len(joined([u, *picked])) <= room:
            picked = [u, *picked]
            continue
        tail = sentence_suffix(u.text, u.kind, room - (len(joined(picked)) + len(GAP) if picked else 0))
        return [Unit(tail, u.kind, u.block_ids, u.pages), *picked] if tail else picked
    return picked


def pack(units: list[Unit], head: int, config: ChunkingConfig) -> list[tuple[list[Unit], int]]:
    """(units, how many of them are overlap) of each chunk (T9). Overlap comes from a chunk's own units only."""
    out: list[tuple[list[Unit], int]] = []
    current: list[Unit] = []
    repeated = 0
    for u in units:
        if current and head + len(GAP) + len(joined([*current, u])) > config.max_chars:
            out.append((current, repeated))
            over = overlap_of(current[repeated:], u, head, config)
            current, repeated = [*over, u], len(over)
        else:
            current.append(u)
    return [*out, (current, repeated)] if current else out


_DRAFT = "document_id string, group_no bigint, draft_no int, heading_path array<string>, content string, page_start bigint, page_end bigint, block_ids array<string>, overlap_chars int, joins int, splits int, atomic int"


def drafts(blocks: DataFrame, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Chunk drafts of body blocks. A task holds one group: the body under one heading. Blocks without a heading path are
    packed under the empty path; headings without text end a group as others do."""
    ship(blocks.sparkSession)
    pathed = blocks.withColumn("heading_path", F.coalesce("heading_path", F.array().cast("array<string>")))
    units = content_units(body_groups(pathed.where(F.col("text").isNotNull() | F.col("block_type").isin(*CONTROL))))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("unit_no")
        path = list(f["heading_path"].iloc[0])
        head = len("\n".join(path))
        rows = [Unit(r.text, r.block_type, list(r.block_ids), (r.page_start, r.page_end)) for r in f.itertuples()]
        parts, splits, atomic = fitted(rows, head, config)
        out = []
        for i, (own, n) in enumerate(pack(parts, head, config)):
            seen = list(dict.fromkeys(b for u in own for b in u.block_ids))
            first = i == 0
            out.append((f["document_id"].iloc[0], f["group_no"].iloc[0], i, path, joined(own), min(u.pages[0] for u in own), max(u.pages[1] for u in own), seen, len(joined(own[:n])), int(f["joins"].sum()) * first, splits * first, atomic * first))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _DRAFT.split(", ")])

    return units.groupBy("document_id", "group_no").applyInPandas(run, _DRAFT)


def chunks(blocks: DataFrame, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Knowledge chunks with ids, hashes and ordinals (PRJ7, W2). With a column ``identity`` of the blocks, that is the document's id in
    the chunk ids."""
    d = drafts(blocks, config)
    identity = F.col("identity") if "identity" in blocks.columns else F.col("document_id")
    facts = blocks.groupBy("document_id").agg(F.min(identity).alias("identity"), F.min("source_path").alias("source_path"), F.min("normalization_version").alias("normalization_version"))
    w = Window.partitionBy("document_id").orderBy("group_no", "draft_no")
    at = d.join(facts, "document_id").withColumn("ordinal", F.row_number().over(w).cast("bigint")).withColumn("content_hash", ids.content_hash(F.col("content")))
    at = at.withColumn("chunking_version", F.lit(config.version)).withColumn("index_text", index_text(F.col("heading_path"), F.col("content")))
    return at.withColumn("chunk_id", ids.chunk_id(*[F.col(c) for c in ("identity", "heading_path", "block_ids", "content_hash", "chunking_version")])).select(
        "chunk_id", "document_id", "content", "index_text", "heading_path", "page_start", "page_end", "ordinal", "block_ids", "source_path", "content_hash", "normalization_version", "chunking_version"
    )


def report(drafted: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row of counters (AGG8)."""
    counts = drafted.agg(F.count("*").alias("output_chunk_count"), F.sum("joins").alias("cross_page_joins"), F.sum("splits").alias("split_units"), F.sum("atomic").alias("oversized_atomic_units"), F.count_if(F.col("overlap_chars") > 0).alias("overlapped_chunks"), F.sum("overlap_chars").alias("overlap_chars"))
    return counts.join(F.broadcast(blocks.agg(F.count("*").alias("input_block_count"))))


def bounds(blocks: DataFrame, drafted: DataFrame, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """(kind, n): chunks over the limit with a block that isn't atomic, and body blocks with text, whatever their heading
    path, that are in no chunk."""
    body = blocks.where(~F.col("block_type").isin(*CONTROL, *NOT_INDEXED) & ~is_blank(F.col("text"))).select(F.col("block_id").alias("x"), "block_type")
    long = drafted.where(F.char_length("content") + F.char_length(F.array_join("heading_path", "\n")) + len(GAP) > config.max_chars).select(F.explode("block_ids").alias("x"))
    long = long.join(body.where(F.col("block_type").isin(*ATOMIC)).select("x"), "x", "left_anti")
    lost = body.join(drafted.select(F.explode("block_ids").alias("x")), "x", "left_anti")
    return long.agg(F.lit("long").alias("kind"), F.count("*").alias("n")).unionByName(lost.agg(F.lit("lost").alias("kind"), F.count("*").alias("n")))
