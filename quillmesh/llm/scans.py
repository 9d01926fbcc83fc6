"""Problem 4: debris of scanning in the blocks of scanned books, and their paragraphs whole again.

Method: sequence labelling of lines by a hidden Markov model with the labels header (running headers, footers, page
numbers), body (the paragraph goes on after this line) and break (it ends with this line). The hidden states also know whether a
paragraph has begun and is still open, over headers too, so that what stands before and after a line decides with it: the moves between an open
and a closed paragraph are forbidden where they make no sense. The moves depend on the line's place in its block (first, last). A line emits four features of the layout, independently of each other: how it
begins (letter case), how it ends (mark, no letters), both by the kind of the block and whether only short lines lie between it and the page's border, its room (edge of the page, length), and its likeness to a page
number (shape, counts on with the pages, style of the other numbers) or to other lines of the book (repeats, with wrong letters too, titles). None of them is a label. Weak labels by a few simple rules start the Viterbi training and keep half of the
weight in it. It runs on at most ``TRAIN_GROUPS`` groups; every line is labelled by the Viterbi path of its group
of ``SPAN`` blocks in reading order, with ``HALO`` blocks of the neighbours as context, so that a book of any size is many tasks.

Words broken at a line's end are joined if the joined word is more frequent in the corpus than the word with the
hyphen (then the mark is part of it); unknown words by their letters. A word is misread if undoing a usual confusion
of the scanner (``CONFUSIONS``) gives a word ``RATIO`` times as frequent; a Han character if both
pairs it forms are rare where one other character between the same neighbours is ``RATIO`` times as frequent. Counts are of all blocks.

A book is scanned if the source path of any of its blocks begins with ``scans/``. Null texts are no lines; blocks without
id or document are left out; repeated rows count once. Code, tables, equations and labels are not running text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import ship, spread

SPAN = 512
HALO = 24
TRAIN_GROUPS = 48
#: Most scanned books whose ids, some 10 MB, are broadcast; with more, blocks are joined with them by shuffle.
MOST_BOOKS = 100_000
RATIO = 12
RUNNING = ("paragraph", "list_item")
MARKS = "-‐‑¬\xad"
#: What a scanner reads for what, as (read, printed).
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("rn", "m"), ("cl", "d"), ("c", "e"), ("ii", "u"), ("li", "h"),
    ("vv", "w"), ("I", "l"), ("l", "i"), ("i", "l"), ("f", "t"), ("t", "f"), ("e", "c"), ("m", "rn"), ("d", "cl"), ("n", "u"), ("u", "n"), ("h", "b"), ("q", "g"), ("4", "a"), ("3", "e"), ("2", "z"), ("7", "t"), ("o", "0"),
)
_HAN = "㐀-䶿一-鿿豈-﫿"
_TERMINAL = re.compile(r"[.!?。！？।…:：;；][”’\"'»›)\]」』）】“]*\s*$")
_PAGE_WORD = r"(?:page|p|pp|seite|s|página|pág|pag|p[áa]gina|第|页|頁|-|—|–|·|\[|\]|\(|\)|/|(?<=[a-zA-Z])\.|of|von|de|sur|\s)"
_NUMBER = re.compile(rf"^{_PAGE_WORD}*\d{{1,5}}(?:\s*/\s*\d{{1,5}})?{_PAGE_WORD}*$", re.I)
_ROMAN = re.compile(r"^[\s\-—·\[(]*(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})[\s\-—·\])]*$", re.I)
_AS_DIGITS = str.maketrans("lIiOoSsBZzgq", "111005582299")
_LETTER = rf"[^\W_{_HAN}]"
_WORD = re.compile(rf"{_LETTER}+(?:[-‐‑'’]{_LETTER}+)*")
_RUN = re.compile(f"[{_HAN}]+")
_DIGITS = re.compile(r"\d+")
_WITH_DIGITS = re.compile(r"\w*\d\w*")
_AROUND = re.compile(r"^[#\s]+|[#\s]+$")
_CAN_START = re.compile(r"[^\W_]")
_SOME_LETTER = re.compile(r"[^\W\d_]")
_BLANKS = re.compile(r"\s{2,}|[^\S ]")
_MARKED = re.compile(rf"[{MARKS}][ \t]*(?:\n|$)")
_BROKEN = re.compile(rf"((?:{_LETTER}|[-_])+)[{MARKS}][ \t]*\n[ \t]*({_LETTER}+(?:-\w+)*)")


def is_number(line: str) -> bool:
    """Whether a line looks like a page number, misread ones and Roman ones included."""
    t = line.strip()
    if not t or len(t) > 20:
        return False
    if _NUMBER.match(t) or _ROMAN.match(t):
        return True
    return bool(any(c.isdigit() for c in t) and len(t) <= 14 and _NUMBER.match(as_digits(t)))


def as_digits(line: str) -> str:
    """Letters that stand for digits put right, in tokens that have a digit."""
    return _WITH_DIGITS.sub(lambda m: m[0].translate(_AS_DIGITS), line)


def number_in(line: str) -> int | None:
    """The first number of a page number; None for a Roman one."""
    m = re.search(r"\d+", as_digits(line))
    return int(m[0]) if m else None


def key_of(line: str) -> str:
    """A line with its numbers and case taken out."""
    if _DIGITS.search(line):
        line = _DIGITS.sub("#", line)
    return (_BLANKS.sub(" ", line) if _BLANKS.search(line) else line).strip().casefold()


def key_column(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"[0-9]+", "#"), r"\s+", " ")))


# ---------------------------------------------------------------- lines of a group of pages


@lru_cache(maxsize=50_000)
def similar(a: str, b: str) -> bool:
    """Whether two short lines differ by a few letters only."""
    if abs(len(a) - len(b)) > 3 or len(a) < 5:
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= 0.8 and m.quick_ratio() >= 0.8 and m.ratio() >= 0.8


#: Hidden states: a line that starts a paragraph and one inside it, both with more to come; the line that ends one, and one that
#: is a whole paragraph; headers while a paragraph is open and while none is.
START, INSIDE, END, SINGLE, OVER_OPEN, OVER_CLOSED = range(6)
STATES = 6
#: What may come before each state: an open paragraph or none.
FROM = ((END, SINGLE, OVER_CLOSED), (START, INSIDE, OVER_OPEN), (START, INSIDE, OVER_OPEN), (END, SINGLE, OVER_CLOSED), (START, INSIDE, OVER_OPEN), (END, SINGLE, OVER_CLOSED))
_FOLLOWING = [(came, [k for k in range(STATES) if FROM[k] == came]) for came in sorted(set(FROM))]
HEADER, BODY, BREAK = 0, 1, 2
LABELS = (BODY, BODY, BREAK, BREAK, HEADER, HEADER)
_TYPES = {"paragraph": 0, "list_item": 1, "section_heading": 2, "document_title": 2}
#: Of each observed feature, in the order of ``observed``, the numbers of what it depends on and of its values.
SIZES = ((16, 4), (16, 5), (4, 20), (1, 22))


#: Rows of one group, by column.
Group = dict[str, list]


class Line(NamedTuple):
    row: int
    text: str
    seen: tuple[int, ...]  # place in the block (2 if its first line, plus 1 if its last), features of the layout
    weak: int  # a first guess at the label, for the start of the training only


def begin_of(line: str) -> int:
    m = _CAN_START.search(line)
    c = m[0] if m else ""
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def end_of(line: str) -> int:
    t = line.rstrip()
    if not _SOME_LETTER.search(t):
        return 4
    return 1 if t[-1] in MARKS else 2 if t[-1] in ",，、" else 0 if _TERMINAL.search(t) else 3


def observed(f: Group) -> list[Line]:
    """The lines of a group, whose rows are in reading order, with their place in the block and four features of the layout: how
    they begin, how they end, their room on the page, and their likeness to page numbers or to lines of other pages."""
    n = len(f["text"])
    texts, types, first, last, repeats, heads = (f[c] for c in ("text", "block_type", "page_start", "page_end", "repeats", "head"))
    lines = [t.split("\n") if isinstance(t, str) else [] for t in texts]
    on_page: dict[int, list[int]] = defaultdict(list)
    for i in range(n):
        on_page[first[i]].append(i)
    top, bottom, edge = [False] * n, [False] * n, [False] * n
    for rows in on_page.values():
        for i in rows[:2] + rows[-2:]:
            edge[i] = True
        for reached, order in ((top, rows), (bottom, rows[::-1])):  # up to the first block that isn't a short line
            for i in order[:4]:
                reached[i] = True
                if types[i] != "figure_label" and not (len(lines[i]) == 1 and types[i] == "paragraph" and len(lines[i][0]) <= 90):
                    break
    single = [i for i in range(n) if len(lines[i]) == 1 and types[i] == "paragraph" and edge[i]]
    numbers = {i for i in single if is_number(lines[i][0])}
    styles = {key_of(as_digits(lines[i][0])) for i in numbers}
    ahead = Counter(v - first[i] for i in numbers if (v := number_in(lines[i][0])) is not None)
    offset = next((o for o, c in ahead.most_common(1) if c >= 3), None)  # pages are counted on: number less page
    head_keys = {key_of(lines[i][0]) for i in single if repeats[i] and i not in numbers}
    titles = {key_of(h) for h in heads if h} | {key_of(lines[i][0]) for i in range(n) if len(lines[i]) == 1 and types[i] in ("document_title", "section_heading")}
    likes = sorted(head_keys | {t for t in titles if len(t) >= 5})
    longest = max(map(len, head_keys), default=0) + 12
    out = []
    for i in range(n):
        kind = _TYPES.get(types[i], 3)
        if types[i] == "figure_label":
            continue
        size = len(lines[i])
        alone = size == 1
        for j, line in enumerate(lines[i]):
            long = len(line)
            shape = counter = style = repeat = title = 0
            if kind == 0 and long <= 90 and (alone or long <= max(longest, 20)) and line.strip():
                if is_number(line):
                    v = number_in(line)
                    shape = 2 if v is None else 1
                    counter = 0 if v is None else 3 if offset is None else 1 if offset in (v - first[i], v - last[i]) else 2
                    style = int(key_of(as_digits(line)) in styles)
                else:
                    k = key_of(line)
                    worded = _SOME_LETTER.search(k) is not None
                    bare = _AROUND.sub("", k)
                    repeat = int(worded and (k in head_keys or alone and repeats[i]))
                    title = int(worded and bool({k, bare} & titles))
                    if worded and not repeat and not title and (alone and edge[i] or long < 45) and not _TERMINAL.search(line) and any(similar(k, x) or similar(bare, x) for x in likes):
                        repeat = 2
            ends = end_of(line)
            room = 0 if long <= 8 else 1 if long <= 20 else 2 if long <= 45 else 3 if long <= 90 else 4
            begins, stops = j == 0, j == size - 1
            seen = (
                begins * 2 + stops,
                ((kind * 2 + begins) * 2 + top[i]) * 4 + begin_of(line),
                ((kind * 2 + stops) * 2 + bottom[i]) * 5 + ends,
                (((begins * 2 + stops) * 2 + edge[i]) * 5 + room) * 2 + (kind == 0),
                (shape - 1) * 8 + counter * 2 + style if shape else 16 + repeat * 2 + title,
            )
            like = shape and counter != 2 if alone else shape and counter == 1 and style
            if kind == 0 and (edge[i] and alone and (like or repeat or title) or not alone and room < 3 and (like or repeat == 1)):
                weak = HEADER
            elif j < size - 1 or kind == 0 and 0 < ends < 4 and bottom[i]:
                weak = BODY
            else:
                weak = BREAK
            out.append(Line(i, line, seen, weak))
    return out


def states_of(labels: list[int]) -> list[int]:
    """The hidden states that labels amount to."""
    out, open_ = [], False
    for k in labels:
        if k == HEADER:
            out.append(OVER_OPEN if open_ else OVER_CLOSED)
        else:
            out.append((INSIDE if open_ else START) if k == BODY else (END if open_ else SINGLE))
            open_ = k == BODY
    return out


class Model:
    """Log probabilities of a hidden Markov model: the moves, by the place of the line that is entered, and for each feature its
    emissions by state. Every book begins as after a closed paragraph."""

    def __init__(self, move: np.ndarray, emit: list[np.ndarray]) -> None:
        self.move, self.emit = move, emit
        self.known: dict[tuple[int, ...], list[float]] = {}
        self.ways = [[[(came, float(move[place, came, to])) for came in FROM[to]] for to in range(STATES)] for place in range(4)]

    @classmethod
    def fitted(cls, sequences: list[tuple[list[tuple[int, ...]], list[int], float]]) -> Model:
        """From features with states and a weight; every event is thought to have been seen a little."""
        move = np.zeros((4, STATES, STATES))
        for to, came in enumerate(FROM):
            move[:, list(came), to] = 0.01
        emit = [np.full((STATES, given * values), 0.05) for given, values in SIZES]
        for seen, states, weight in sequences:
            if states:
                at = np.array(states)
                columns = np.array(seen).T
                np.add.at(move, (columns[0], np.concatenate([[END], at[:-1]]), at), weight)
                for e, column in zip(emit, columns[1:], strict=True):
                    np.add.at(e, (at, column), weight)
        with np.errstate(divide="ignore"):
            logs = [np.log((e := x.reshape(STATES, given, values)) / e.sum(2, keepdims=True)).reshape(STATES, -1) for x, (given, values) in zip(emit, SIZES, strict=True)]
            return cls(np.log(move / move.sum(2, keepdims=True)), logs)

    def score(self, seen: tuple[int, ...]) -> list[float]:
        got = self.known.get(seen)
        if got is None:
            got = self.known[seen] = sum(e[:, x] for e, x in zip(self.emit, seen[1:], strict=True)).tolist()
        return got

    def path(self, seen: list[tuple[int, ...]]) -> list[int]:
        """The Viterbi path; plain numbers, since so few states are too few for arrays to pay. States that follow an open paragraph
        look at the three open ones, the others at the three closed ones."""
        total = [0.0 if k == END else -1e9 for k in range(STATES)]
        back = []
        for o in seen:
            e, ways = self.score(o), self.ways[o[0]]
            new, came = [0.0] * STATES, [0] * STATES
            for (p, q, r), following in _FOLLOWING:
                u, v, w = total[p], total[q], total[r]
                for k in following:
                    (_, x), (_, y), (_, z) = ways[k]
                    x += u
                    y += v
                    z += w
                    if x >= y and x >= z:
                        new[k], came[k] = x + e[k], p
                    elif y >= z:
                        new[k], came[k] = y + e[k], q
                    else:
                        new[k], came[k] = z + e[k], r
            total = new
            back.append(came)
        out = [total.index(max(total))]
        for came in reversed(back):
            out.append(came[out[-1]])
        return out[-2::-1]

    @classmethod
    def trained(cls, sequences: list[tuple[list[tuple[int, ...]], list[int]]], rounds: int = 3, keep: float = 1.0, doubt: float = 0.03) -> Model:
        """Viterbi training: weak labels start it and stay with the weight ``keep`` beside the model's own paths. A paragraph that they let go
        on after its block is in doubt: it may end there, too, so that its surroundings can overrule them."""
        prior = []
        for seen, labels in sequences:
            ended = [BREAK if k == BODY and o[0] & 1 else k for k, o in zip(labels, seen, strict=True)]
            prior += [(seen, states_of(labels), keep * (1 - doubt)), (seen, states_of(ended), keep * doubt)]
        model = cls.fitted(prior)
        for _ in range(rounds):
            model = cls.fitted([*prior, *((seen, model.path(seen), 1.0) for seen, _ in sequences)])
        return model


# ---------------------------------------------------------------- tables


def scanned(blocks: DataFrame) -> DataFrame:
    """Blocks of scanned books; rows that repeat a block are sorted out in their group, without a shuffle of its own. Blocks without
    a page stand on pages of their own, below 0; those without a place in the reading order, before all others."""
    books = blocks.where(F.col("source_path").startswith("scans/")).select("document_id").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    few = len(books.limit(MOST_BOOKS + 1).select(F.lit(1)).collect()) <= MOST_BOOKS
    rows = blocks.where(F.col("document_id").isNotNull() & F.col("block_id").isNotNull()).join(F.broadcast(books) if few else books, "document_id", "left_semi")
    rows = rows.withColumn("ordinal", F.coalesce("ordinal", -1 - F.pmod(F.xxhash64("block_id"), F.lit(1 << 30))))
    page = F.coalesce("page_start", -1 - F.pmod("ordinal", F.lit(1 << 40)))
    return rows.select("block_id", "document_id", "text", "block_type", F.try_element_at("heading_path", F.lit(1)).alias("head"), page.alias("page_start"), F.coalesce("page_end", page).alias("page_end"), "ordinal", "ingested_at")


def near_groups() -> Column:
    """The groups a row stands in: its own, and the neighbour's if it is near its end."""
    return F.array_distinct(F.array(*[F.floor((F.col("ordinal") + d) / SPAN) for d in (0, -HALO, HALO)]))


def repeated_keys(blocks: DataFrame) -> DataFrame:
    """(document_id, part, key): of each group the single lines, by their keys, that stand on several pages of their book or in several
    books. Only keys go through the joins, each with its groups one by one."""
    line = (F.instr("text", "\n") == 0) & (F.char_length("text") <= 90) & (F.col("block_type") == "paragraph") & ~F.col("text").rlike(r"[.!?。！？:：;；,，]\s*$")
    short = blocks.where(line).select("document_id", "page_start", near_groups().alias("parts"), F.col("text").alias("t")).select("document_id", "page_start", "parts", key_column(F.col("t")).alias("key")).where("key != ''")
    each = short.select("document_id", "key", "page_start", F.explode("parts").alias("part")).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    pages = each.select("document_id", "key", "page_start").distinct().groupBy("document_id", "key").agg(F.count("*").alias("n"))
    books = pages.groupBy("key").agg(F.count("*").alias("books"))
    known = pages.join(books, "key").where("n >= 3 or books >= 3 or (n >= 2 and books >= 2)").select("document_id", "key")
    return each.select("document_id", "part", "key").distinct().join(known, ["document_id", "key"], "left_semi")


def grouped(blocks: DataFrame) -> DataFrame:
    """Rows by group, a stretch of the reading order; those near its ends stand in the neighbour's group, too, as context."""
    return blocks.withColumn("home", F.floor(F.col("ordinal") / SPAN)).withColumn("part", F.explode(near_groups()))


def in_order(t: pa.Table, known: set[str]) -> Group:
    """A group's rows in reading order, each block once, with ``repeats``: whether its text is a single line of the ``known`` keys."""
    f = {c: t[c].to_pylist() for c in t.column_names}
    taken = t["ingested_at"].cast(pa.int64()).to_pylist() if pa.types.is_timestamp(t["ingested_at"].type) else [None] * t.num_rows
    ids, ordinals = f["block_id"], f["ordinal"]
    first: dict[str, int] = {}
    for i in sorted(range(t.num_rows), key=lambda i: (ordinals[i], ids[i], taken[i] is None, taken[i] or 0)):
        first.setdefault(ids[i], i)
    f = {c: [v[i] for i in first.values()] for c, v in f.items()}
    f["repeats"] = [kind == "paragraph" and text is not None and len(text) <= 90 and "\n" not in text and key_of(text) in known for text, kind in zip(f["text"], f["block_type"], strict=True)]
    return f


def mapped(groups: DataFrame, keys: DataFrame, run: Callable[[Group], pa.Table], schema: str, empty: pa.Schema) -> DataFrame:
    """``run`` over each group, its rows in order and marked by its repeated keys."""

    def each(f: pa.Table, k: pa.Table) -> pa.Table:
        return run(in_order(f, set(k["key"].to_pylist()))) if f.num_rows else empty.empty_table()

    a = groups.select(*[F.col(c).alias(c) for c in groups.columns])  # new columns, as both sides come from one table
    b = keys.select(F.col("document_id").alias("book"), F.col("part").alias("stretch"), "key")
    return a.groupBy("document_id", "part").cogroup(b.groupBy("book", "stretch")).applyInArrow(each, schema)


def model_of(blocks: DataFrame, groups: DataFrame, repeated: DataFrame, most: int = TRAIN_GROUPS) -> Model:
    """The model, trained on the groups with the least hashes; their features, of some 20,000 lines each at most, are all that
    comes to the driver."""
    part = F.floor(F.col("ordinal") / SPAN).alias("part")
    keys = blocks.select("document_id", part).distinct().orderBy(F.xxhash64("document_id", "part"), "document_id", "part").limit(most).persist()

    kind = pa.schema([("s", pa.list_(pa.int32())), ("w", pa.list_(pa.int32()))])

    def run(f: Group) -> pa.Table:
        rows = observed(f)[:20_000]
        return pa.table({"s": [[x for r in rows for x in r.seen]], "w": [[r.weak for r in rows]]}, schema=kind)

    by = ["document_id", "part"]
    got = mapped(groups.join(keys, by, "left_semi"), repeated.join(keys, by, "left_semi"), run, "s array<int>, w array<int>", kind).collect()
    keys.unpersist()
    m = len(SIZES) + 1
    return Model.trained([([tuple(r.s[i : i + m]) for i in range(0, len(r.s), m)], list(r.w)) for r in got])


class Found(NamedTuple):
    row: int
    lines: list[str]
    labels: list[int]
    goes_on: bool  # on the next page, in the next block
    next_line: str  # that block's first body line
    continues: bool  # it is such a next block


def label_group(f: Group, model: Model) -> list[Found]:
    """The lines of a group's own rows with their labels by the Viterbi path. A paragraph goes on if its last line is labelled
    body and the next block that isn't all headers is a paragraph on the next page."""
    rows = observed(f)
    path = model.path([r.seen for r in rows])
    n = len(f["text"])
    lines: list[list[str]] = [[] for _ in range(n)]
    labels: list[list[int]] = [[] for _ in range(n)]
    for r, state in zip(rows, path, strict=True):
        lines[r.row].append(r.text)
        labels[r.row].append(LABELS[state])
    own, types = [h == p for h, p in zip(f["home"], f["part"], strict=True)], f["block_type"]
    first, last = f["page_start"], f["page_end"]
    for i, t in enumerate(f["text"]):
        if types[i] == "figure_label" and isinstance(t, str):
            lines[i] = t.split("\n")
            labels[i] = [BODY] * (len(lines[i]) - 1) + [BREAK]
    out: list[Found] = []
    before, open_ = -1, False  # the last block with running text
    goes, continues = [False] * n, [False] * n
    following = [-1] * n
    for i in range(n):
        body = [k for k in labels[i] if k != HEADER]
        if not body or types[i] == "figure_label":
            continue
        if before >= 0:
            following[before] = i
            if open_ and types[i] == types[before] == "paragraph" and first[i] == last[before] + 1:
                goes[before] = continues[i] = True
        before, open_ = i, body[-1] == BODY
    for i in range(n):
        if own[i]:
            j = following[i]
            nxt = next(x for x, k in zip(lines[j], labels[j], strict=True) if k != HEADER) if j >= 0 else ""
            out.append(Found(i, lines[i], labels[i], goes[i], nxt, continues[i]))
    return out


_LINES = "block_id string, document_id string, block_type string, page_start bigint, page_end bigint, ordinal bigint, home bigint, lines array<string>, labels array<int>, goes_on boolean, next_line string, continues boolean"


_LINE_SCHEMA = pa.schema(
    [
        ("block_id", pa.string()), ("document_id", pa.string()), ("block_type", pa.string()), ("page_start", pa.int64()), ("page_end", pa.int64()), ("ordinal", pa.int64()), ("home", pa.int64()),
        ("lines", pa.list_(pa.string())), ("labels", pa.list_(pa.int32())), ("goes_on", pa.bool_()), ("next_line", pa.string()), ("continues", pa.bool_()),
    ]
)


def labelled(blocks: DataFrame) -> DataFrame:
    """Each block with its lines, their labels (0 header, 1 body, 2 break), whether its paragraph goes on in the next
    block on the next page, that block's first body line, and whether it continues the block before."""
    spark = blocks.sparkSession
    ship(spark)
    groups, keys = grouped(blocks), repeated_keys(blocks).persist(StorageLevel.MEMORY_AND_DISK)
    sent = spark.sparkContext.broadcast(model_of(blocks, groups, keys))

    def run(f: Group) -> pa.Table:
        found = label_group(f, sent.value)
        columns = [[f[c][x.row] for x in found] for c in _LINE_SCHEMA.names[:7]] + [[x[i] for x in found] for i in range(1, 6)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _LINE_SCHEMA.types, strict=True)], schema=_LINE_SCHEMA)

    return mapped(groups, keys, run, _LINES, _LINE_SCHEMA)


_FACTS = "block_id string, furniture boolean, inline boolean, goes_on boolean, words array<string>, breaks array<struct<joined:string,hyphened:string,sure:boolean>>"


_BREAK = pa.struct([("joined", pa.string()), ("hyphened", pa.string()), ("sure", pa.bool_())])
_FACT_SCHEMA = pa.schema([("block_id", pa.string()), ("furniture", pa.bool_()), ("inline", pa.bool_()), ("goes_on", pa.bool_()), ("words", pa.list_(pa.string())), ("breaks", pa.list_(_BREAK))])


def examined(blocks: DataFrame, wanted: np.ndarray) -> DataFrame:
    """What ``findings`` needs of each block, without its text: the layout, those of its words that ``wanted``, a filter, lets through, and
    its broken words."""
    spark = blocks.sparkSession
    ship(spark)
    groups, keys = grouped(blocks), repeated_keys(blocks).persist(StorageLevel.MEMORY_AND_DISK)
    sent = spark.sparkContext.broadcast((model_of(blocks, groups, keys), wanted))

    def run(f: Group) -> pa.Table:
        model, bits = sent.value
        ids, types = f["block_id"], f["block_type"]
        out: list[tuple] = []
        words: list[set[str]] = []
        for i, lines, labels, on, nxt, _ in label_group(f, model):
            header = labels.count(HEADER)
            whole = bool(labels) and header == len(labels)
            own: set[str] = set()
            breaks: list[tuple[str, str, str]] = []
            if not whole:
                text, breaks = break_parts(lines, labels, on, nxt)
                if types[i] in RUNNING:
                    own = words_and_triples(text)
            words.append(own)
            out.append((ids[i], whole, header > 0 and not whole, on, [{"joined": j, "hyphened": h, "sure": by_letters(j, h, m)} for j, h, m in breaks]))
        some = passed(set().union(*words), bits)
        columns = [*zip(*out, strict=True)] if out else [()] * 5
        columns.insert(4, [sorted(own & some) for own in words])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _FACT_SCHEMA.types, strict=True)], schema=_FACT_SCHEMA)

    return mapped(groups, keys, run, _FACTS, _FACT_SCHEMA)


# ---------------------------------------------------------------- a filter of fixed size

FILTER_BITS = 1 << 25
FILTER_HASHES = 4


def filter_of(words: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``word``. It has the same size, 4 MB, whatever the number of words: with many of them it lets
    more through, which the join behind it sorts out."""
    h = F.xxhash64("word")
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    bits = words.select(F.explode(F.array(*[F.pmod(low + high * i, F.lit(FILTER_BITS)) for i in range(FILTER_HASHES)])).alias("b"))
    cells = bits.select(F.floor(F.col("b") / 32).cast("int").alias("at"), F.expr("shiftleft(1L, cast(b % 32 as int))").alias("bit")).groupBy("at").agg(F.expr("bit_or(bit)").alias("bit"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    got = cells.toPandas()  # at most FILTER_BITS / 32 rows of two numbers
    out[got["at"].to_numpy(np.int64)] = got["bit"].to_numpy(np.int64).astype(np.uint32)
    return out


def passed(words: set[str], bits: np.ndarray) -> set[str]:
    """The words that the filter lets through."""
    import xxhash

    each = list(words)
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 42) for w in each), np.uint64, len(each))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    ok = np.ones(len(each), bool)
    for i in range(FILTER_HASHES):
        b = (low + high * np.uint64(i)) % np.uint64(FILTER_BITS)
        ok &= (bits[(b // np.uint64(32)).astype(np.int64)] >> (b % np.uint64(32)).astype(np.uint32)) & np.uint32(1) == 1
    return {each[i] for i in np.flatnonzero(ok)}


# ---------------------------------------------------------------- words


def counted(text: str, words: Counter, triples: Counter, pairs: Counter) -> None:
    """Adds a text's words, those broken at line ends left out, and the triples and pairs of its Han runs, ``^`` and ``$``
    being their ends."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if _MARKED.search(text):
        text = re.sub(rf"\w+[{MARKS}]\s*$", " ", _BROKEN.sub(" ", text))
    words.update(_WORD.findall(text))
    if "\n" in text:
        text = text.replace("\n", "")
    for r in _RUN.findall(text):
        if len(r) > 1:
            t = f"^{r}$"
            pairs.update(map("".join, zip(t, t[1:], strict=False)))
            triples.update(map("".join, zip(t, t[1:], t[2:], strict=False)))


def words_and_triples(text: str) -> set[str]:
    """The words of a text and the triples of its Han runs, marked by ``3:``."""
    out = set(_WORD.findall(text))
    if not text.isascii():
        for r in _RUN.findall(text.replace("\n", "")):
            if len(r) > 1:
                t = f"^{r}$"
                out.update([f"3:{t[i : i + 3]}" for i in range(len(r))])
    return out


def word_counts(blocks: DataFrame) -> DataFrame:
    """(word, n) over the running text of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())

        def emit() -> pa.RecordBatch:
            keys = [p + w for p, c in zip(("", "3:", "2:"), found, strict=True) for w in c]
            counts = [n for c in found for n in c.values()]
            for c in found:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                counted(t, *found)
            if sum(map(len, found)) > 300_000:
                yield emit()
        yield emit()

    text = blocks.where(F.col("text").isNotNull() & F.col("block_type").isin(*RUNNING, "figure_caption", "section_heading")).select("text")
    return spread(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def unread(word: str) -> list[str]:
    """What a misread word may have been: one confusion undone at any one place."""
    out = []
    if len(word) < 3 or word.isdigit():
        return out
    for read, printed in CONFUSIONS:
        i = word.find(read)
        while i >= 0:
            out.append(word[:i] + printed + word[i + len(read) :])
            i = word.find(read, i + 1)
    return out


def misread_words(counts: DataFrame) -> DataFrame:
    """(word, right): misread words and Han triples with what was printed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            wrong: list[int] = []
            rare: list[int] = []
            right: list[int] = []
            for w, n, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                options = unread(w)
                wrong += [h] * len(options)
                rare += [n] * len(options)
                right += [xxhash.xxh64_intdigest(r.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(r.encode(), 42) >> 63 else 0) for r in options]
            yield pa.RecordBatch.from_arrays([pa.array(wrong, pa.int64()), pa.array(rare, pa.int64()), pa.array(right, pa.int64())], names=["wrong", "rare", "h"])

    # words are joined by the 64-bit hash that Spark's xxhash64 gives, a third of their size; the words found are compared again
    letters = counts.where(~F.col("word").startswith("3:") & ~F.col("word").startswith("2:")).withColumn("h", F.xxhash64("word"))
    options = letters.select("word", "n", "h").mapInArrow(run, "wrong bigint, rare bigint, h bigint")
    latin = options.join(letters, "h").where(F.col("n") >= F.col("rare") * RATIO)
    latin = latin.groupBy("wrong").agg(F.max_by("word", F.struct("n", "word")).alias("right"))
    latin = latin.join(letters.select(F.col("h").alias("wrong"), "word"), "wrong").select("word", "right")

    tri = counts.where(F.col("word").startswith("3:")).select(F.substring("word", 3, 1).alias("a"), F.substring("word", 4, 1).alias("x"), F.substring("word", 5, 1).alias("b"), "n")
    best = tri.groupBy("a", "b").agg(F.max_by("x", F.struct("n", "x")).alias("y"), F.max("n").alias("m"))
    rare = tri.join(best, ["a", "b"]).where(F.col("n") * RATIO <= F.col("m"))
    two = counts.where(F.col("word").startswith("2:"))

    def pair(df: DataFrame, p: str, q: str, name: str) -> DataFrame:
        return df.withColumn("word", F.concat(F.lit("2:"), F.col(p), F.col(q))).join(two.withColumnRenamed("n", name), "word").drop("word")

    for p, q, name in (("a", "x", "ax"), ("a", "y", "ay"), ("x", "b", "xb"), ("y", "b", "yb")):
        rare = pair(rare, p, q, name)
    rare = rare.where((F.col("ax") * RATIO <= F.col("ay")) & (F.col("xb") * RATIO <= F.col("yb")))
    han = rare.select(F.concat(F.lit("3:"), "a", "x", "b").alias("word"), F.concat("a", "y", "b").alias("right"))
    return latin.unionByName(han)


def break_parts(lines: list[str], labels: list[int], goes_on: bool, next_line: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The running text of a block with broken words joined, and its breaks (joined, with hyphen, mark)."""
    text = "\n".join(x for x, k in zip(lines, labels, strict=True) if k)
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    tail = goes_on and re.search(rf"\w[{MARKS}]\s*$", text) is not None
    whole = text + "\n" + next_line if tail else text
    breaks = []
    for m in _BROKEN.finditer(whole) if _MARKED.search(whole) else ():
        mark = whole[m.end(1)]
        head = m[1].lstrip("-")
        breaks.append((head + m[2], head + "-" + m[2], mark))
    return _BROKEN.sub(lambda m: m[1] + m[2], whole) if breaks else whole, breaks


def by_letters(joined: str, hyphened: str, mark: str) -> bool:
    """Whether an unknown word was broken by a mark that isn't part of it."""
    head, _, tail = hyphened.rpartition("-")
    return mark not in "-‑" or tail[:1].islower() and head[-1:].islower()


def joined_breaks(breaks: DataFrame, counts: DataFrame) -> DataFrame:
    """Of broken words (block_id, joined, hyphened, sure) those whose mark isn't part of the word."""
    at = breaks.join(counts.select(F.col("word").alias("joined"), F.col("n").alias("whole")), "joined", "left").join(counts.select(F.col("word").alias("hyphened"), F.col("n").alias("parts")), "hyphened", "left")
    return at.where(F.when(F.coalesce("whole", "parts").isNull(), F.col("sure")).otherwise(F.coalesce("whole", F.lit(0)) >= F.coalesce("parts", F.lit(0)))).select("block_id", "joined", "hyphened")


def findings(blocks: DataFrame) -> DataFrame:
    """(block_id, kind): what scanning did to each block of scanned books."""
    ship(blocks.sparkSession)
    counts = word_counts(blocks).persist(StorageLevel.MEMORY_AND_DISK)
    wrong = misread_words(counts).persist(StorageLevel.MEMORY_AND_DISK)
    facts = examined(scanned(blocks), filter_of(wrong)).persist(StorageLevel.MEMORY_AND_DISK)
    kinds = F.array_compact(F.array(F.when(F.col("furniture"), "furniture"), F.when(F.col("inline"), "inline"), F.when(F.col("goes_on"), "continued")))
    out = facts.select("block_id", F.explode(kinds).alias("kind"))
    misread = facts.select("block_id", F.explode("words").alias("word")).join(wrong, "word", "left_semi").select("block_id", F.lit("misread").alias("kind"))
    breaks = joined_breaks(facts.select("block_id", F.explode("breaks").alias("b")).select("block_id", "b.*"), counts).select("block_id", F.lit("hyphen").alias("kind"))
    return out.unionByName(misread).unionByName(breaks).distinct()


def repairs(body: DataFrame, counts: DataFrame) -> DataFrame:
    """(block_id, fixes): for each block its broken words that are one and its misread words with the printed ones."""
    wrong = misread_words(counts).persist(StorageLevel.MEMORY_AND_DISK)
    sent = body.sparkSession.sparkContext.broadcast(filter_of(wrong))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words, breaks = [], [], []
            for r in b.to_pylist():
                text, found = break_parts(r["lines"] or [], r["labels"] or [], r["goes_on"], r["next_line"] or "")
                own = words_and_triples(text) if r["block_type"] in RUNNING else set()
                ids.append(r["block_id"])
                words.append(sorted(passed(own, sent.value)) if own else [])
                breaks.append([{"joined": j, "hyphened": h, "sure": by_letters(j, h, m)} for j, h, m in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(breaks, pa.list_(_BREAK))], names=["block_id", "words", "breaks"])

    parts = body.select("block_id", "block_type", "lines", "labels", "goes_on", "next_line").mapInArrow(run, "block_id string, words array<string>, breaks array<struct<joined:string,hyphened:string,sure:boolean>>").persist(StorageLevel.MEMORY_AND_DISK)
    misread = parts.select("block_id", F.explode("words").alias("word")).join(wrong, "word").select("block_id", F.lit("misread").alias("kind"), "word", "right")
    joined = joined_breaks(parts.select("block_id", F.explode("breaks").alias("b")).select("block_id", "b.*"), counts).select("block_id", F.lit("hyphen").alias("kind"), F.col("hyphened").alias("word"), F.col("joined").alias("right"))
    return misread.unionByName(joined).groupBy("block_id").agg(F.collect_set(F.struct("kind", "word", "right")).alias("fixes"))


def paragraphs(blocks: DataFrame) -> DataFrame:
    """(document_id, block_ids, page_start, page_end, text): the paragraphs of scanned books, debris removed, broken words
    joined, misread words put right, and parts on consecutive pages put together. Pages are null where no part has one.

    A block knows from its group whether it continues the one before. Blocks are numbered within groups; only the last beginning
    of each group, one row for ``SPAN`` blocks, is ordered over the whole book."""
    ship(blocks.sparkSession)
    lines = labelled(scanned(blocks)).persist(StorageLevel.MEMORY_AND_DISK)
    body = lines.where(F.exists("labels", lambda x: x > 0))
    fixes = repairs(body, word_counts(blocks).persist(StorageLevel.MEMORY_AND_DISK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [cleaned(r["lines"], r["labels"], r["block_type"], r["fixes"] or [], r["next_line"] if r["goes_on"] else None) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([g for _, g in out], pa.bool_())], names=["block_id", "text", "glued"])

    clean = body.select("block_id", "block_type", "lines", "labels", "goes_on", "next_line").join(fixes, "block_id", "left").mapInArrow(run, "block_id string, text string, glued boolean")
    place = body.where(F.col("block_type") != "figure_label").select("block_id", "document_id", "home", "ordinal", "page_start", "page_end", "continues")
    begin = F.when(~F.col("continues"), F.struct("ordinal", "block_id"))
    borders = place.groupBy("document_id", "home").agg(F.max(begin).alias("last"))
    earlier = Window.partitionBy("document_id").orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    borders = borders.select("document_id", "home", F.last("last", ignorenulls=True).over(earlier).alias("open"))
    within = Window.partitionBy("document_id", "home").orderBy("ordinal", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    head = place.withColumn("__head", F.last(begin, ignorenulls=True).over(within)).join(borders, ["document_id", "home"])
    head = head.withColumn("__head", F.coalesce("__head", "open", F.struct("ordinal", "block_id")))
    parts = F.sort_array(F.collect_list(F.struct("ordinal", "block_id", "text", "glued")))
    whole = head.join(clean, "block_id").groupBy("document_id", "__head").agg(parts.alias("p"), F.min(_page("page_start")).alias("page_start"), F.max(_page("page_end")).alias("page_end"))
    nothing = F.struct(F.lit("").alias("text"), F.lit(True).alias("glued"))
    text = F.aggregate("p", nothing, _joined, lambda x: x["text"])
    return whole.select("document_id", F.transform("p", lambda x: x["block_id"]).alias("block_ids"), "page_start", "page_end", text.alias("text"))


def _page(name: str) -> Column:
    return F.when(F.col(name) >= 0, F.col(name))


def _joined(done: Column, part: Column) -> Column:
    """Two parts of a paragraph: after a broken word and between Han there is no space."""
    han = done["text"].rlike(f"[{_HAN}，。、；：]$") & part["text"].rlike(f"^[{_HAN}]")
    text = F.concat(done["text"], F.when(done["glued"] | han, "").otherwise(" "), part["text"])
    return F.struct(text.alias("text"), part["glued"].alias("glued"))


def cleaned(lines: list[str], labels: list[int], block_type: str, fixes: list[dict], next_line: str | None = None) -> tuple[str, bool]:
    """A block's text without its headers, in one line if it is running text, and whether the first line of the next block, given if the
    paragraph goes on there, must follow without a space. A mark that breaks a word goes; one that is part of it stays."""
    text = "\n".join(x for x, k in zip(lines, labels, strict=True) if k)
    if block_type not in RUNNING:
        return text, False
    joins = {f["word"] for f in fixes if f["kind"] == "hyphen"}

    def mended(m: re.Match) -> str:
        return m[1] if m[1].lstrip("-") + "-" + m[2] in joins else m[1] + "-"

    glued = False
    if next_line and re.search(rf"\w[{MARKS}]\s*$", text):
        for m in _BROKEN.finditer(text + "\n" + next_line):
            if m.end(2) > len(text):
                text, glued = text[: m.start()] + mended(m), True
                break
    text = _BROKEN.sub(lambda m: mended(m) + m[2], text)
    words = {f["word"]: f["right"] for f in fixes if f["kind"] == "misread"}
    text = _WORD.sub(lambda m: words.get(m[0], m[0]), text)
    text = re.sub(rf"(?<=[{_HAN}，。、；：？！])\n(?=[{_HAN}，。、；：？！“”])", "", text)
    if any(w.startswith("3:") for w in words):
        text = _RUN.sub(lambda m: _printed(m[0], words), text)
    return re.sub(r"\s*\n\s*", " ", text), glued


def _printed(run: str, words: dict[str, str]) -> str:
    """A Han run with the middle of each misread triple put right; the triple stands where its neighbours do."""
    t = f"^{run}$"
    return "".join(words.get("3:" + t[i : i + 3], t[i : i + 3])[1] for i in range(len(run))) if len(run) > 1 else run
