"""Problem 5: sentences of texts in many languages and scripts.

Method: the boundary rules (``step``) are compiled into a finite transducer by exploring all states reachable from the
start. It reads classes of characters and writes marks (a sentence may end here), commits (the last mark is an
end) and blanks (an empty line ends what came before). A long text is read in chunks of bytes: each chunk is first turned into
its state-transition function, the functions are composed by a parallel prefix scan (``scanned_entries``), and every chunk is then
read again from its true entry state, so that the result is that of one pass.

Rules: ``.`` ends a sentence before white space and the start of another one, but not after abbreviations, in ordinals,
decimals and addresses; ``etc.`` and the like end one only before a capital. Closing quotes and brackets belong to
the sentence. After a quoted question or exclamation, a comma, a dash, a lower-case word or (in Chinese and
Japanese) a speaker with a verb of speech goes on with the sentence. Ellipses end a sentence only before a capital. Han and
kana texts need no white space after their marks. Thai ends sentences at spaces. An empty line and the end of
the text always end a sentence.

Null, empty and blank texts have no sentences. End positions are in code points, closing marks included, white space after
it not. Invisible characters and combining marks change nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import ship, spread

CHUNK = 1 << 16
#: Abbreviations after which a sentence goes on. A capital first letter is required where written.
NEVER = (
    "Dr|Prof|Mr|Mrs|Ms|St|No|Nr|Nos|fig|figs|sec|secs|ch|eq|eqs|vol|pp|p|vs|e.g|i.e|e. g|i. e|cf|approx|resp|ref|refs|"
    "z. B|z.B|d. h|d.h|u. a|z. T|bzw|ca|abb|tab|kap|abs|vgl|bd|sog|evtl|inkl|"
    "p. ex|c.-à-d|M|MM|env|chap|éd|art|av|p. ej|pág|págs|núm|aprox|Sr|Sra|Srta|Dra|Profa|cap|n.º|ej|ex|"
    "см|рис|табл|т. е|т.е|стр|гл|напр|ср|им|ул|тыс|млн|डॉ|प्रो"
).split("|")
#: Abbreviations that may end a sentence, too.
MAYBE = "etc|et al|Inc|Ltd|Co|Corp|Jr|a.m|p.m|usw|u. s. w|usf|EE. UU|Ud|Uds|и т. д|и т.д|и т. п|и др|т. д|т. п|др|гг|г".split("|")
#: Words before an ordinal number, which ends with a full stop in German.
ORDINAL = "am|vom|zum|den|dem|bis|seit|ab".split("|")
#: Marks.
FULL, FULL_ASK, ASK, CLOSERS, OPENERS, DASHES, COMMAS = "。．｡", "？！", "?!؟‼⁇⁈⁉", "”’»›)]}」』）】》〉］｣", "«‹„‚¿¡([{「『（【《〈‘［｢", "—–―", ",;:，、；：،"
#: Han characters in verbs of speech.
SPEECH = "问問说説說道答喊叫嚷"
_LOOK = 24
_CAMEL = 8


class State(NamedTuple):
    mode: str  # T text, P after a mark, L a lower-case word after a mark, S a speaker after a mark
    node: int = 0  # place in the trie of abbreviations; -1: inside another word
    thai: bool = False  # Thai letters since the last space
    lines: int = 0  # 1: white space with a line end
    kind: str = ""  # mark: . ? f F e d t
    abbr: str = ""  # n, m of the word before a full stop
    closed: bool = False
    space: bool = False
    left: int = 0  # characters to look at in L and S


MARK, COMMIT, BLANK, BEFORE = 1, 2, 4, 8


class Trie:
    """Abbreviations by classes of characters; a space stands for any white space."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[str] = [""]
        self.text: list[str] = [""]
        entries = [(a, "n") for a in NEVER] + [(a, "m") for a in MAYBE]
        entries += [(f"{w} {d}", "n") for w in ORDINAL for d in ("0", "00")]
        for a, kind in entries:
            for form in {a, "".join(c for c in unicodedata.normalize("NFD", a) if not unicodedata.combining(c))}:
                for first in {form[0], form[0].upper()}:
                    self._add(first + form[1:] + ".", kind)

    def _add(self, text: str, kind: str) -> None:
        at = 0
        for c in text:
            if c not in self.next[at]:
                self.next.append({})
                self.ends.append("")
                self.text.append(self.text[at] + c)
                self.next[at][c] = len(self.next) - 1
            at = self.next[at][c]
        self.ends[at] = kind

    def go(self, node: int, c: str) -> int:
        """The node after ``c``; where the path breaks off, that of the words since a later space; -1 if none."""
        while True:
            if c in self.next[node]:
                return self.next[node][c]
            _, space, rest = self.text[node].partition(" ")
            if not space:
                return -1
            node = self.find(rest)
            if node < 0:
                return -1

    def find(self, text: str) -> int:
        at = 0
        for c in text:
            at = self.next[at].get(c, -1)
            if at < 0:
                return -1
        return at


TRIE = Trie()
_LETTERS = sorted({c for n in TRIE.next for c in n if c not in ". 0-"})


def class_of(c: str) -> str:
    """The class of a character: itself if the trie or a rule needs it, else a class named by a word."""
    if "Ａ" <= c <= "ｚ" or "０" <= c <= "９":
        c = unicodedata.normalize("NFKC", c)
    if c in _LETTERS:
        return c
    if c in FULL:
        return "full"
    if c in FULL_ASK:
        return "fullask"
    if c in ASK:
        return "ask"
    if c in "।॥":
        return "danda"
    if c in "\n\x0b\x0c\x85\u2028\u2029\r":
        return "line" if c != "\r" else "space"
    if c.isspace():
        return "space"
    if c in CLOSERS:
        return "close"
    if c in OPENERS:
        return "open"
    if c in DASHES:
        return "dash"
    if c in COMMAS:
        return "comma"
    if c in SPEECH:
        return "speech"
    if c in ".…\"'“-と":
        return c
    kind = unicodedata.category(c)
    if kind in ("Mn", "Me", "Cf"):
        return "none" if not "฀" <= c <= "๿" else "thai"
    if kind == "Nd":
        return "0"
    if kind == "Lu" or kind == "Lt":
        return "upper"
    if kind == "Ll":
        return "lower"
    if "฀" <= c <= "๿":
        return "thai"
    if kind[0] == "L" or kind == "Mc":
        return "han" if "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or c >= "\U00020000" or "⺀" <= c <= "⿟" or c in "々〇" else "letter"
    return "other"


CLASSES = sorted({*_LETTERS, *".…\"'“-と", "full", "fullask", "ask", "danda", "line", "space", "close", "open", "dash", "comma", "speech", "none", "0", "upper", "lower", "thai", "han", "letter", "other"})
_UPPER = {c for c in _LETTERS if c.isupper()} | {"upper"}
_LOWER = {c for c in _LETTERS if c.islower()} | {"lower"}
_CASELESS = {c for c in _LETTERS if not c.isupper() and not c.islower()} | {"letter"}
_HAN = {"han", "speech", "と"}
_WORD = _UPPER | _LOWER | _CASELESS | {"0", "thai"} | _HAN
_QUOTES = {"close", '"', "'", "“"}


def _text(s: State, c: str) -> tuple[State, int]:
    """A character of running text (not white space, not a mark)."""
    node = s.node
    if c in _WORD or c in ("-",):
        after = TRIE.go(node, c) if node >= 0 else -1
        node = after if after >= 0 else (-1 if c in _WORD and c not in _HAN else 0)
    else:
        node = 0
    return State("T", node, s.thai and s.mode == "T" or c == "thai"), 0


def _white(s: State, c: str) -> tuple[State, int]:
    """White space in running text."""
    line = c == "line"
    if line and s.lines:
        return State("T", 0, False, 1), BLANK
    if s.thai:
        return State("P", 0, False, int(line), "t", space=True), BEFORE
    node = max(TRIE.go(s.node, " "), 0) if s.node > 0 else 0
    return State("T", node, False, int(line or s.lines)), 0


def step(s: State, c: str) -> tuple[State, int]:
    """The boundary rules: the next state and what is written on reading a character of class ``c``."""
    if c == "none":
        return s, 0
    if s.mode == "T":
        if c in ("space", "line"):
            return _white(s, c)
        if c == ".":
            node = TRIE.go(s.node, ".") if s.node > 0 else -1
            return State("P", max(node, 0), s.thai, 0, ".", TRIE.ends[node] if node > 0 else ""), MARK
        if c in ("ask", "full", "fullask", "danda", "…"):
            return State("P", 0, s.thai, 0, {"ask": "?", "full": "f", "fullask": "F", "danda": "d", "…": "e"}[c]), MARK
        return _text(s, c)
    if s.mode == "P":
        return _after_mark(s, c)
    fresh = State("T")
    if s.mode == "L":  # a lower-case word: only one with a capital inside (eBGP) starts a sentence
        if c in _UPPER or c in ("open", "other", "0"):  # also a name in code
            return State("T", -1), COMMIT
        if c in _LOWER and s.left > 1:
            return s._replace(left=s.left - 1, node=_text(State("T", s.node), c)[0].node), 0
        return step(State("T", s.node), c)
    # S: a speaker in Han or kana, with a verb of speech
    if c == "speech":
        return fresh, 0
    if c in _HAN or c in _UPPER or c in _LOWER or c == "0" or c == "space":
        return (s._replace(left=s.left - 1), 0) if s.left > 1 else (fresh, COMMIT)
    after, out = step(fresh, c)
    return after, COMMIT | (out << 4 if out & (MARK | BEFORE) else out)


def _after_mark(s: State, c: str) -> tuple[State, int]:
    if c in ("space", "line"):
        if c == "line" and s.lines:
            return State("T", 0, False, 1), BLANK
        node = TRIE.next[s.node].get(" ", 0) if s.node and not s.space else 0
        return s._replace(space=True, lines=int(c == "line" or s.lines), node=node), 0
    if not s.space:
        if c == ".":
            return s._replace(kind="e" if s.kind in ".e" else s.kind, abbr="", node=0), MARK
        if c in ("ask", "fullask", "full", "danda", "…"):
            kind = {"ask": "?", "fullask": "F", "full": "f", "danda": "d", "…": "e"}[c]
            return s._replace(kind=kind if s.kind in ".te" else s.kind, abbr="", node=0), MARK
        if c in _QUOTES and not (c == "“" and s.kind in "fF"):
            return s._replace(closed=True, node=0), MARK
    if c in ("comma", "dash"):
        return State("T"), 0
    begin, _ = _text(State("T"), c)
    goes_on = TRIE.next[s.node].get(c) if s.node else None
    if s.kind in ".e" and s.abbr != "m" and goes_on is not None and not s.closed:  # inside an abbreviation of several parts
        return State("T", goes_on, s.thai), 0
    if s.kind == "." and s.abbr == "m" and goes_on is not None and not s.space:
        return State("T", goes_on), 0
    if s.kind == "d" or s.kind == "t":
        if c in ("close", "other", "-") and s.kind == "t":
            return begin, 0
        return begin, COMMIT
    if s.kind in "fF":
        if s.closed and c == "と":
            return begin, 0
        if s.kind == "F" and s.closed and not s.space and (c in _HAN or c in _UPPER):
            return (State("T"), 0) if c == "speech" else (State("S", left=_LOOK), 0)
        return begin, COMMIT
    if s.kind == "e" and not s.closed:
        if s.space and (c in _UPPER or c in ("open", '"', "“")):
            return begin, COMMIT
        return _text(State("T", 0, s.thai), c)
    # full stop, question or exclamation mark in a script with spaces, or a closed ellipsis
    if not s.space:
        if s.kind == "?" and c in _HAN | {"thai", "open"} or s.kind == "." and c in _HAN and s.closed:
            return begin, COMMIT
        return _text(State("T", -1 if c in _WORD and not s.closed else 0, s.thai), c)
    if s.kind == "." and s.abbr == "n" and not s.closed:
        return begin, 0
    if c in _LOWER:
        return (State("L", begin.node, left=_CAMEL), 0) if not s.abbr else (begin, 0)
    if c == "0" and s.abbr:
        return begin, 0
    if c in _UPPER or c in _CASELESS or c in _HAN or c in ("0", "thai", "open", '"', "“", "'"):
        return begin, COMMIT
    return _text(State("T"), c)


class Transducer(NamedTuple):
    rows: list[list[int]]  # rows[state][class] = next << 8 | output
    classes: np.ndarray  # of the code points below 0x10000
    han: int
    other: int
    none: int


@cache
def transducer() -> Transducer:
    """The rules compiled: every reachable state gets a number, 0 being the start."""
    numbers: dict[State, int] = {State("T"): 0}
    todo, rows = [State("T")], []
    while todo:
        s = todo.pop(0)
        row = []
        for c in CLASSES:
            after, out = step(s, c)
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            row.append(numbers[after] << 8 | out)
        rows.append(row)
    number = {c: i for i, c in enumerate(CLASSES)}
    table = np.array([number[class_of(chr(i))] if not 0xD800 <= i < 0xE000 else number["other"] for i in range(0x10000)], np.uint8)
    return Transducer(rows, table, number["han"], number["other"], number["none"])


def classes(text: str) -> bytes:
    t = transducer()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = codes > 0xFFFF
    out = t.classes[np.where(high, 0, codes)]
    if high.any():
        out[high] = np.where((codes[high] >= 0x20000) & (codes[high] < 0x40000), t.han, t.other)
    return out.tobytes()


def events(symbols: bytes, state: int = 0) -> tuple[list[tuple[int, int]], int]:
    """What is written on reading ``symbols`` from ``state``: (position, output), and the state at the end."""
    rows = transducer().rows
    out = []
    row = rows[state]
    k = state << 8
    for i, c in enumerate(symbols):
        k = row[c]
        if k & 255:
            out.append((i, k & 255))
        row = rows[k >> 8]
    return out, k >> 8


def function(symbols: bytes) -> list[int]:
    """The state-transition function of a chunk: for each entry state the state at the end. All states are followed at
    once until they have met in few."""
    rows = transducer().rows
    table = np.array(rows, np.int32) >> 8
    at = np.arange(len(rows))
    i = 0
    while i < len(symbols):
        at = table[at, symbols[i]]
        i += 1
        if i % 64 == 0 and len(set(at.tolist())) <= 4:
            break
    rest = symbols[i:]
    ends = {s: events(rest, s)[1] for s in set(at.tolist())}
    return [ends[s] for s in at.tolist()]


def ends_of(text: str, found: list[tuple[int, int]], mark: int = -1, last: int = 0, final: bool = True) -> list[int]:
    """Sentence ends from the events of a text: ``mark`` is the mark before it, ``last`` the end before it."""
    out: list[int] = []

    def end(p: int) -> None:
        nonlocal last
        if p > last and not text[last:p].isspace():
            out.append(p)
            last = p

    for i, what in found:
        if what & COMMIT and mark > 0:
            end(mark)
            mark = -1
        if what & BLANK:
            end(len(text[:i].rstrip()) if i - last < 4096 else _rstrip(text, i))
            mark = -1
        later = what >> 4 if what >= 16 else what
        if later & MARK:
            mark = i + 1
        elif later & BEFORE:
            mark = i
    if final:
        end(_rstrip(text, len(text)))
    return out


def _rstrip(text: str, i: int) -> int:
    while i > 0 and text[i - 1].isspace():
        i -= 1
    return i


def sentence_ends(text: str | None) -> list[int]:
    """End positions of the sentences of one text."""
    if not text or text.isspace():
        return []
    return ends_of(text, events(classes(text))[0])


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of one text, without white space before them."""
    out, at = [], 0
    for e in sentence_ends(text):
        while at < e and text[at].isspace():  # type: ignore[index]
            at += 1
        out.append((at, e))
        at = e
    return out


def _per_text(f: Callable[[str], Any], name: str, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([f(t) for t in b.column(b.num_columns - 1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], got], names=[*b.schema.names[:-1], name])

    return run


def short_ends(texts: DataFrame) -> DataFrame:
    """(key, ends) of texts (key, text) that fit a chunk."""
    return texts.mapInArrow(_per_text(sentence_ends, "ends", pa.list_(pa.int64())), "key string, ends array<bigint>")


_PART = pa.schema([("key", pa.string()), ("i", pa.int32()), ("part", pa.binary()), ("f", pa.binary()), ("chars", pa.int64())])
_READ = pa.schema([("key", pa.string()), ("i", pa.int32()), ("ends", pa.list_(pa.int64())), ("commits", pa.bool_()), ("blanks", pa.bool_()), ("mark", pa.int64()), ("seen", pa.int64())])


def chunks_of(texts: DataFrame, chunk: int) -> DataFrame:
    """(key, i, part) of texts (key, text): byte ranges, cut in time proportional to the text. A part begins with its first whole
    character and ends with the one that reaches over its end."""
    data = texts.select("key", F.encode("text", "utf-8").alias("data"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / chunk)).cast("int")
    return data.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).select("key", "i", F.substring("data", F.col("i") * chunk + 1, F.lit(chunk + 3)).alias("part"))


def part_text(part: bytes, i: int, chunk: int) -> str:
    a, b = 0, min(chunk, len(part))
    while i and a < len(part) and part[a] & 0xC0 == 0x80:
        a += 1
    while b < len(part) and part[b] & 0xC0 == 0x80:
        b += 1
    return part[a:b].decode("utf-8", "replace")


def scanned_entries(functions: DataFrame, block: int = 256) -> DataFrame:
    """(key, i, entry, base): the state in which each chunk is entered and the characters before it, by a parallel prefix scan of
    chunks' functions (key, i, f, chars) in two sweeps. Up: the functions of each block of ``block`` chunks are composed into one. Then the
    blocks of a text are entered one after the other: at most 128 of 16 M characters, as a text holds 2 GB. Down: each block enters its chunks."""
    rows = functions.withColumn("block", F.floor(F.col("i") / block).cast("int"))

    def composed(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("i")
        whole = np.frombuffer(f["f"].iloc[0], np.int16)
        for nxt in f["f"].iloc[1:]:
            whole = np.frombuffer(nxt, np.int16)[whole]
        return pd.DataFrame({"key": [f["key"].iloc[0]], "block": [f["block"].iloc[0]], "f": [whole.tobytes()], "chars": [f["chars"].sum()]})

    def entered(f: pd.DataFrame, at: str, state: int, base: int) -> pd.DataFrame:
        f = f.sort_values(at)
        entry, before = [], []
        for fn, chars in zip(f["f"], f["chars"], strict=True):
            entry.append(state)
            before.append(base)
            state, base = int(np.frombuffer(fn, np.int16)[state]), base + chars
        return pd.DataFrame({"key": f["key"], at: f[at], "entry": entry, "base": before})

    up = rows.groupBy("key", "block").applyInPandas(composed, "key string, block int, f binary, chars bigint")
    top = up.groupBy("key").applyInPandas(lambda f: entered(f, "block", 0, 0), "key string, block int, entry int, base bigint")
    down = rows.join(top, ["key", "block"]).groupBy("key", "block")
    return down.applyInPandas(lambda f: entered(f, "i", int(f["entry"].iloc[0]), int(f["base"].iloc[0])), "key string, i int, entry int, base bigint")


def read_chunk(text: str, entry: int, base: int) -> tuple[list[int], bool, bool, int | None, int | None]:
    """What a chunk says when it is read from its true state: the ends inside; whether a commit takes a mark, and an empty line a last character,
    from before the chunk; the open mark at its end (-1: none, None: that from before stays); its last character that isn't white space."""
    ends: list[int] = []
    commits = blanks = False
    mark: int | None = None
    for p, what in events(classes(text), entry)[0]:
        if what & COMMIT:
            if mark is None:
                commits = True
            elif mark >= 0:
                ends.append(mark)
            mark = -1
        if what & BLANK:
            q = _rstrip(text, p)
            if q:
                ends.append(base + q)
            else:
                blanks = True
            mark = -1
        later = what >> 4 if what >= 16 else what
        if later & MARK:
            mark = base + p + 1
        elif later & BEFORE:
            mark = base + p
    q = _rstrip(text, len(text))
    return ends, commits, blanks, mark, base + q if q else None


def long_ends(texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, ends) of long texts by chunks of ``chunk`` bytes: functions, prefix scan, second reading. What a chunk takes from those before it
    is found among one row for each chunk."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts_ = [part_text(d, i, chunk) for i, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            fs = [np.array(function(classes(t)), np.int16).tobytes() for t in texts_]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fs, pa.binary()), pa.array([len(t) for t in texts_], pa.int64())], schema=_PART)

    parts = spread(chunks_of(texts, chunk)).mapInArrow(first, "key string, i int, part binary, f binary, chars bigint").persist(StorageLevel.MEMORY_AND_DISK)
    entries = scanned_entries(parts.select("key", "i", "f", "chars"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read_chunk(part_text(d, i, chunk), entry, base) for i, d, entry, base in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True)]
            cols = [pa.array([r[k] for r in rows], _READ.field(k + 2).type) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], schema=_READ)

    said = parts.select("key", "i", "part").join(entries, ["key", "i"]).select("key", "i", "part", "entry", "base")
    said = said.mapInArrow(read, "key string, i int, ends array<bigint>, commits boolean, blanks boolean, mark bigint, seen bigint")
    before = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 64 KB
    mark, seen = F.last("mark", ignorenulls=True).over(before), F.last("seen", ignorenulls=True).over(before)
    taken = F.filter(F.array(F.when(F.col("commits") & (F.col("__m") > 0), F.col("__m")), F.when(F.col("blanks"), F.col("__s"))), lambda x: x.isNotNull())
    said = said.select("key", "ends", "commits", "blanks", "seen", mark.alias("__m"), seen.alias("__s")).select("key", F.concat("ends", taken).alias("ends"), "seen")
    whole = said.groupBy("key").agg(F.flatten(F.collect_list("ends")).alias("ends"), F.max("seen").alias("last"))
    return whole.select("key", F.array_sort(F.array_distinct(F.array_compact(F.concat("ends", F.array("last"))))).alias("ends"))


def sentence_table(texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, ends) of texts (key string, text). Texts stay where they are read; a text within one chunk, the trivial case of the scan, is
    read there. Rows that repeat a key then repeat in the result, too, for ``once_each``."""
    ship(texts.sparkSession)
    some = texts.where("key is not null and text is not null").select("key", "text")
    size = F.octet_length("text")
    long = some.where(size > chunk).dropDuplicates(["key"])
    return short_ends(spread(some.where(size <= chunk))).unionByName(long_ends(long, chunk))


def once_each(table: DataFrame) -> DataFrame:
    """One row for each key, by the small rows of ends instead of the texts."""
    return table.dropDuplicates(["key"])


def probed(probes: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(probe_id, end_pos) of probes (probe_id, record_kind, record_id) on blocks and chunks (id, text). All texts are
    split where they are read, and their ends are joined with the probes: a shuffle of ends, not of texts."""
    asked = probes.where("probe_id is not null").dropDuplicates(["probe_id"])
    key = F.concat_ws("\0", "record_kind", "record_id")
    texts = blocks.select(F.lit("block").alias("record_kind"), F.col("id").alias("record_id"), "text").unionByName(chunks.select(F.lit("chunk").alias("record_kind"), F.col("id").alias("record_id"), "text"))
    table = sentence_table(texts.where("record_id is not null").select(key.alias("key"), "text"))
    wanted = asked.select("probe_id", key.alias("key"))
    found = once_each(table.join(wanted.select("key").distinct(), "key", "left_semi"))
    return wanted.join(found, "key").select("probe_id", F.explode("ends").alias("end_pos"))
