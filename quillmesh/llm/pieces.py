"""Problem 6: oversized texts as pieces under a limit, cut at natural boundaries, with overlap.

Method: byte-range processing. An oversized text is cut into byte ranges with halos of ``max_chars`` characters on
both sides, spread over the workers. Each worker aligns its range to characters, detects the boundaries, and fixes
the cut nearest before the end of its range (the anchor); the neighbour sees the same characters in its halo and
fixes the same one, so ranges are packed independently between anchors. The boundary tables are stitched by prefix
sums over the ranges: of characters for absolute offsets and of pieces for piece numbers. Nothing holds a
whole text; ``split_file`` reads the ranges of a giant file by offset in the same way. ``cut_kinds`` reads its rows
from the same stitched pieces: each carries the first and last stop (white space or mark) of its part of the text and the
longest run between them, so that runs over cuts and range borders are measured by the absolute offsets.

Kinds of boundaries, best first: empty line, line end, sentence end, clause mark, white space. A cut is
made at the best kind in the last ``1 - EARLY`` of the window, else at the last boundary in the window, else
(nothing natural among ``max_chars`` characters) at the limit, but not before a combining mark. A piece after the
first begins up to ``overlap_chars`` before its cut, at the earliest boundary there, or exactly so far where there
is none, and less far where only so its end is a natural place. Pieces without their overlaps join to exactly the text.

Null texts and texts within the limit give no rows; fields without a limit too. The limit must exceed the overlap; another
limit is an error. Of a record that repeats with different texts one text is split; it is forced if any of them is.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.session import ship, spread

RANGE_BYTES = 1 << 18
EARLY = 0.5
#: Characters before an anchor's window that both neighbours surely hold; the rank of an anchor depends on no others.
BEFORE = 7
CLAUSE = "；，、：;,:"
SENTENCE = "。！？.!?।"
#: Marks that, like white space, end a run that can't be cut naturally.
MARKS = SENTENCE + CLAUSE
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
_RANKS = np.zeros(0x110000, np.uint8)
for _rank, _chars in ((1, SPACES), (2, CLAUSE), (3, SENTENCE), (4, "\n\r\x0b\x0c\x85  ")):
    for _c in _chars:
        _RANKS[ord(_c)] = _rank


def boundary_ranks(text: str) -> np.ndarray:
    """For each position p of 0..len the rank of a cut before character p (0: none, 5: after an empty line)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _RANKS[codes]
    rank = np.zeros(len(codes) + 1, np.uint8)
    if len(codes) == 0:
        return rank
    rank[1:] = kind
    inside = np.flatnonzero(kind[1:] > 0) + 1  # no cut between a mark and the marks or spaces that follow it
    rank[inside] = np.where(_SPACE[codes[inside]] | (kind[inside - 1] >= 2) & ~_SPACE[codes[inside - 1]], 0, rank[inside])
    for p in np.flatnonzero((rank > 0) & np.concatenate([[False], _SPACE[codes]])):  # after white space the best kind of its run and of the mark before counts
        q, best, lines = p - 1, int(rank[p]), 0
        while q >= 0 and _SPACE[codes[q]]:
            best, lines = max(best, int(kind[q])), lines + (kind[q] == 4)
            q -= 1
        if q >= 0 and kind[q] in (2, 3):
            best = max(best, int(kind[q]))
        rank[p] = 5 if lines > 1 else best
    digits = [p for p in np.flatnonzero(rank >= 2) if p < len(text) and text[p - 1] in ".,:" and not text[p].isspace()]
    for p in digits:  # decimals, addresses, abbreviations: a weak place
        if text[p].isalnum():
            rank[p] = 1
    return rank


_SPACE = _RANKS == 1
_SPACE |= _RANKS == 4


def best_cut(rank: np.ndarray, text: str, low: int, high: int) -> int:
    """Where to cut in (low, high]: the best kind in the later part, else the last boundary, else the last place beside a stop, else ``high``."""
    from_ = low + max(1, int((high - low) * EARLY))
    part = rank[from_ : high + 1]
    if len(part) and (best := part.max()) > 0:
        return from_ + len(part) - 1 - int(np.argmax(part[::-1] == best))
    part = rank[low + 1 : from_]
    if len(part) and part.any():
        return low + 1 + int(np.flatnonzero(part)[-1])
    if places := beside_stops(text, low + 1, high):
        return places[-1]
    cut = high
    while cut > low + 1 and cut < len(text) and unicodedata.combining(text[cut]):
        cut -= 1
    return cut


def beside_stops(text: str, low: int, high: int) -> list[int]:
    """The places in [low, high] before or after white space or a mark: a cut there is no boundary, but within no run."""
    stop = [bool(_RANKS[ord(c)]) for c in text[low - 1 : high + 1]]
    return [low + i for i in range(len(stop)) if low + i <= high and (stop[i] or i + 1 < len(stop) and stop[i + 1])]


def anchor(text: str, border: int, limit: int) -> int:
    """The cut nearest before a border of two ranges, judged only by characters that both hold, however long a run of white space is; the
    beginning of the text where that is within the limit and nothing natural lies between."""
    low = max(0, border - limit)
    seen = max(0, low - BEFORE)
    part = text[seen : border + 1]
    rank = boundary_ranks(part)
    if border < limit and not rank[1 : border + 1].any() and not beside_stops(part, 1, border):
        return 0
    return seen + best_cut(rank, part, low - seen, border - seen)


def start_of(rank: np.ndarray, cut: int, overlap: int, least: int) -> int:
    """Where the piece after ``cut`` begins, its overlap included."""
    low = max(least, cut - overlap)
    places = np.flatnonzero(rank[low:cut])
    return low + int(places[0]) if len(places) and overlap else low


def pack(text: str, rank: np.ndarray, begin: int, end: int, limit: int, overlap: int, first: bool) -> list[tuple[int, int, int]]:
    """(start, cut before, end) of the pieces between two anchors of ``text``; only the very first has no overlap."""
    out, cut = [], begin
    while cut < end or (first and not out):
        start = cut if first and not out else start_of(rank, cut, overlap, 0)
        high, far = start + limit, min(cut + limit, end)
        if end <= high:
            stop = end
        elif rank[cut + 1 : high + 1].any() or not (stop := beyond(rank, text, high, far, end) if high < far else 0):
            stop = best_cut(rank, text, cut, high)
        else:  # the overlap gives way to a natural cut
            start = start_of(rank, cut, min(overlap, limit - (stop - cut)), 0)
        out.append((start, cut, stop))
        cut = stop
    return out


def beyond(rank: np.ndarray, text: str, high: int, far: int, end: int) -> int:
    """The first natural cut in (high, far], or the end; 0 if there is none."""
    places = np.flatnonzero(rank[high + 1 : far + 1])
    if len(places):
        return high + 1 + int(places[0])
    return end if far == end else next(iter(beside_stops(text, high + 1, far)), 0)


def check_limit(limit: int, overlap: int) -> None:
    """An overlap that fills the limit leaves no room to go on."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError(f"the limit of {limit} characters must exceed the overlap of {overlap}, which must not be negative")


def stop_places(text: str) -> np.ndarray:
    """The positions of white space and marks."""
    return np.flatnonzero(_RANKS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)])


def stops_between(places: np.ndarray, low: int, high: int, zero: int) -> dict:
    """The first and last of ``places`` in [low, high), counted from ``zero``, and the most characters between two that follow each other."""
    own = places[np.searchsorted(places, low) : np.searchsorted(places, high)]
    if not len(own):
        return {"first_stop": None, "last_stop": None, "run": 0}
    return {"first_stop": int(own[0]) - zero, "last_stop": int(own[-1]) - zero, "run": int(np.diff(own).max()) - 1 if len(own) > 1 else 0}


def work_range(data: bytes, left: int, right: int, n_left: bool, n_right: bool, limit: int, overlap: int, texts: bool = True) -> dict:
    """What one range tells: ``data`` is its bytes with ``left`` and ``right`` halo bytes; ``n_left``/``n_right`` say
    whether text goes on there. Offsets are in characters relative to the first character of the range. Without ``texts`` the
    pieces are offsets only."""
    check_limit(limit, overlap)
    a, b = _align(data, left), _align(data, len(data) - right)
    head = data[_align(data, 0) : a].decode("utf-8", "replace")
    own = data[a:b].decode("utf-8", "replace")
    tail = data[b : _align_down(data, len(data))].decode("utf-8", "replace") if right else ""
    text, x, y = head + own + tail, len(head), len(head) + len(own)
    rank, places = boundary_ranks(text), stop_places(text)
    begin = anchor(text, x, limit) if n_left else 0
    end = anchor(text, y, limit) if n_right else len(text)
    rows = pack(text, rank, begin, end, limit, overlap, not n_left) if end > begin else []
    return {
        "max_chars": limit,
        "chars": len(own),
        "pieces": [{"start": s - x, "cut": c - x, "stop": e - x} | stops_between(places, c, e, x) | {"text": text[s:e] if texts else None} for s, c, e in rows],
    }


def _align(data: bytes, i: int) -> int:
    while i < len(data) and data[i] & 0xC0 == 0x80:
        i += 1
    return i


def _align_down(data: bytes, i: int) -> int:
    """The end of the last whole character before ``i``."""
    j = i
    while j > 0 and i - j < 4:
        j -= 1
        if data[j] & 0xC0 != 0x80:
            size = 1 if data[j] < 0x80 else 2 if data[j] < 0xE0 else 3 if data[j] < 0xF0 else 4
            return i if j + size <= i else j
    return i


RANGE_SCHEMA = (
    "field_name string, record_id string, copy bigint, range_no int, max_chars bigint, chars bigint, "
    "pieces array<struct<start:bigint,cut:bigint,stop:bigint,first_stop:bigint,last_stop:bigint,run:bigint,text:string>>"
)


def oversized(texts: DataFrame, limits: DataFrame) -> DataFrame:
    """``texts`` (field_name, record_id, text) over their limit, with max_chars and overlap_chars. Lengths are compared
    in the scan; the few limits are joined as a broadcast only where Spark's own size threshold allows it."""
    known = limits.where("field_name is not null").groupBy("field_name").agg(F.max("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars"))
    return texts.where("text is not null and record_id is not null").join(known, "field_name").where("char_length(text) > max_chars")


def ranges(over: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges with halos of the oversized texts, one row each; ``copy`` tells different texts of a record apart."""
    data = over.withColumn("copy", F.xxhash64("text")).withColumn("data", F.encode("text", "utf-8")).drop("text").withColumn("size", F.octet_length("data"))
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / range_bytes)).cast("int")
    cut = data.withColumn("n", n).withColumn("range_no", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    halo = 4 * (F.col("max_chars") + F.col("overlap_chars") + 8)
    low, high = F.col("range_no") * range_bytes, F.least(F.col("size"), (F.col("range_no") + 1) * range_bytes)
    left = F.least(low, halo).cast("int")
    right = F.least(F.col("size") - high, halo).cast("int")
    part = F.substring("data", (low - left + 1).cast("int"), (high - low + left + right).cast("int"))
    return cut.select("field_name", "record_id", "copy", "max_chars", "overlap_chars", "range_no", "n", left.alias("left"), right.alias("right"), part.alias("part"))


def boundary_table(parts: DataFrame, texts: bool = True) -> DataFrame:
    """One row for each range: its characters and its pieces with their stops, without the texts if these are not wanted; repeated rows once."""
    ship(parts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                got = work_range(r["part"], r["left"], r["right"], r["range_no"] > 0, r["range_no"] < r["n"] - 1, r["max_chars"], r["overlap_chars"], texts)
                rows.append({"field_name": r["field_name"], "record_id": r["record_id"], "copy": r["copy"], "range_no": r["range_no"]} | got)
            yield pa.RecordBatch.from_pylist(rows, schema=_RANGE_ARROW)

    return parts.mapInArrow(run, RANGE_SCHEMA).dropDuplicates(["field_name", "record_id", "copy", "range_no"])


_RANGE_ARROW = pa.schema(
    [
        ("field_name", pa.string()), ("record_id", pa.string()), ("copy", pa.int64()), ("range_no", pa.int32()), ("max_chars", pa.int64()), ("chars", pa.int64()),
        ("pieces", pa.list_(pa.struct([*((c, pa.int64()) for c in ("start", "cut", "stop", "first_stop", "last_stop", "run")), ("text", pa.string())]))),
    ]
)


def placed(tables: DataFrame) -> DataFrame:
    """Pieces with absolute offsets and numbers, by prefix sums over the ranges of each text: (field_name, record_id, copy, max_chars, piece_no,
    start_pos, end_pos, overlap, first_stop, last_stop, run, text)."""
    by = Window.partitionBy("field_name", "record_id", "copy").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    at = tables.withColumn("__chars", F.coalesce(F.sum("chars").over(by), F.lit(0))).withColumn("__pieces", F.coalesce(F.sum(F.size("pieces")).over(by), F.lit(0)))
    out = at.select("field_name", "record_id", "copy", "max_chars", "__chars", "__pieces", F.posexplode("pieces").alias("i", "p"))
    return out.select(
        "field_name", "record_id", "copy", "max_chars", (F.col("__pieces") + F.col("i") + 1).alias("piece_no"), (F.col("__chars") + F.col("p.start")).alias("start_pos"),
        (F.col("__chars") + F.col("p.stop")).alias("end_pos"), (F.col("p.cut") - F.col("p.start")).alias("overlap"), (F.col("__chars") + F.col("p.first_stop")).alias("first_stop"),
        (F.col("__chars") + F.col("p.last_stop")).alias("last_stop"), F.col("p.run").alias("run"), F.col("p.text").alias("text"),
    )


def stitched(tables: DataFrame) -> DataFrame:
    """The pieces of one text of each record: (field_name, record_id, piece_no, start_pos, end_pos, overlap, text)."""
    one = tables.withColumn("__one", F.min("copy").over(Window.partitionBy("field_name", "record_id"))).where("copy = __one").drop("__one")
    return placed(one).select("field_name", "record_id", "piece_no", "start_pos", "end_pos", "overlap", "text")


def split(texts: DataFrame, limits: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of all oversized texts; a record repeated with the same id is split once."""
    return stitched(boundary_table(spread(ranges(oversized(texts, limits), range_bytes))))


def coverage(cut: DataFrame, limits: DataFrame) -> DataFrame:
    """(field_name, record_id, chars, gaps, too_long, too_much_overlap) of each split record: the characters its pieces cover, and how many pieces
    don't begin where the one before ends, pass the limit, or share more than the overlap."""
    by = Window.partitionBy("field_name", "record_id").orderBy("piece_no")
    at = cut.withColumn("__before", F.lag("end_pos", 1, 0).over(by)).join(limits.select("field_name", "max_chars", "overlap_chars"), "field_name")
    fresh = F.col("start_pos") + F.col("overlap")
    length = F.char_length("text")
    return at.groupBy("field_name", "record_id").agg(
        F.sum(length - F.col("overlap")).alias("chars"), F.count_if((fresh != F.col("__before")) | (F.col("end_pos") - F.col("start_pos") != length)).alias("gaps"),
        F.count_if(length > F.col("max_chars")).alias("too_long"), F.count_if(F.col("overlap") > F.col("overlap_chars")).alias("too_much_overlap"),
    )


def longest_runs(cut: DataFrame) -> DataFrame:
    """(field_name, record_id, copy, max_chars, longest) of ``placed`` pieces: the most characters of each text that follow each other without a
    stop, within a piece, from the last stop of the pieces before to the first of a piece, or to the end."""
    by = Window.partitionBy("field_name", "record_id", "copy").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last("last_stop", ignorenulls=True).over(by), F.lit(-1))
    texts = cut.withColumn("__run", F.greatest("run", F.col("first_stop") - before - 1)).groupBy("field_name", "record_id", "copy", "max_chars")
    last = F.max("end_pos") - F.coalesce(F.max("last_stop"), F.lit(-1)) - 1
    return texts.agg(F.greatest(F.max("__run"), last).alias("longest"))


def cut_kinds(texts: DataFrame, limits: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(field_name, record_id, cut_kind): ``forced`` where a run of the stitched pieces is over the limit, so that a cut must lie within it.
    This doesn't depend on the overlaps; one that the limit can't hold counts as none here."""
    fits = F.col("overlap_chars").between(0, F.col("max_chars") - 1)
    over = oversized(texts, limits).withColumn("overlap_chars", F.when(fits, F.col("overlap_chars")).otherwise(0))
    runs = longest_runs(placed(boundary_table(spread(ranges(over, range_bytes)), texts=False)))
    kinds = runs.groupBy("field_name", "record_id").agg(F.bool_or(F.col("longest") > F.col("max_chars")).alias("forced"))
    return kinds.select("field_name", "record_id", F.when(F.col("forced"), "forced").otherwise("natural").alias("cut_kind"))


def fields(*parts: tuple[DataFrame, str, str, str]) -> DataFrame:
    """(field_name, record_id, text) of several (table, id, text column, field name)."""
    def one(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("field_name"), F.col(key).cast("string").alias("record_id"), F.col(text).alias("text"))

    return reduce(DataFrame.unionByName, [one(*p) for p in parts])


def split_file(spark: SparkSession, path: str, limit: int, overlap: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of one giant UTF-8 file in a folder all workers share: the driver only asks for its size, each worker
    reads its range and halos by offset."""
    check_limit(limit, overlap)
    size = Path(path).stat().st_size
    halo = 4 * (limit + overlap + 8)
    n = max(1, -(-size // range_bytes))
    plan = spark.range(n).select(F.col("id").cast("int").alias("range_no"))
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                low, high = i * range_bytes, min(size, (i + 1) * range_bytes)
                left, right = min(low, halo), min(size - high, halo)
                with open(path, "rb") as f:
                    f.seek(low - left, os.SEEK_SET)
                    data = f.read(high - low + left + right)
                got = work_range(data, left, right, i > 0, i < n - 1, limit, overlap)
                rows.append({"field_name": "file", "record_id": path, "copy": 0, "range_no": i} | got)
            yield pa.RecordBatch.from_pylist(rows, schema=_RANGE_ARROW)

    whole = size and size > limit
    tables = plan.mapInArrow(run, RANGE_SCHEMA) if whole else plan.mapInArrow(run, RANGE_SCHEMA).where(F.lit(False))
    return stitched(tables)


