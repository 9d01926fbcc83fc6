"""Problem 2: how much each term marks a record against the whole collection.

Method: divergence from randomness, model G L 2. With F the occurrences of a term in all N records, lambda = F / N,
and tfn = tf * log2(1 + c * avgdl / dl), a term scores

    (tfn * log2((1 + lambda) / lambda) + log2(1 + lambda)) / (tfn + 1),

the information content under the geometric (Bose-Einstein) model times the after-effect gain of Laplace.

Terms: text is folded for width and case first. Words of scripts that write spaces are runs of letters, marks and
digits that begin with a letter or digit. Runs of Han, kana, Thai and other scripts without spaces give every character
n-gram of the lengths ``GRAMS``, 1 to 16, and a longer run itself; other substrings of more than 16 characters get no
score, as a run of n characters has about n * n / 2 of them. Their length is counted in characters. With a vocabulary the
scores are of its entries wherever they stand: an entry that begins or ends with a Latin letter or a digit must not stand
inside a longer word or number there, any other entry counts wherever it occurs, overlapping occurrences included.

A vocabulary of any size stays distributed. Its terms are put into a Bloom filter of fixed size by a rolling hash, and every substring of a text
that has the length of some term and may begin one is held against the filter, those of many texts at once for each length; the few that
pass are compared with the vocabulary itself by joins. Statistics cover all records, repeated ids once. Null and empty
texts are records without terms: they count in N and have length 0. Ties are broken by term.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import ship, spread

#: Lengths of the terms of scripts without spaces; a longer run is one term more, as a whole.
GRAMS = tuple(range(1, 17))
C = 1.0
#: Size of the filter of a vocabulary: 8 MB, whatever its number of terms.
FILTER_BITS = 1 << 26
FILTER_HASHES = 4
#: Scripts without spaces between words, as ranges of code points (fixed values).
_NO_SPACES = "฀-໿က-႟ក-៿々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
#: Combining marks of the scripts with spaces: vowel signs, viramas and accents belong to the word before them.
_MARKS = "".join(c for c in map(chr, [*range(0x20000), *range(0xE0100, 0xE01F0)]) if unicodedata.category(c)[0] == "M")
_RUN = re.compile(f"[{_NO_SPACES}]+|(?![{_NO_SPACES}_])\\w(?:(?![{_NO_SPACES}_])[\\w{_MARKS}])*")
_UNSPACED = re.compile(f"[{_NO_SPACES}]")
_ODD = re.compile("[＀-￯゙゚̀-ͯᄀ-ᇿ豈-﫿]")
_WIDTH = {i: unicodedata.normalize("NFKC", chr(i)) for i in range(0xFF00, 0xFFF0) if unicodedata.decomposition(chr(i)).startswith(("<wide>", "<narrow>"))}


def fold(text: str) -> str:
    """One form for all width forms and letter cases."""
    if _ODD.search(text):
        text = unicodedata.normalize("NFC", text.translate(_WIDTH))
    return text.casefold()


def is_latin(c: str) -> bool:
    return c.isdigit() or c.isalpha() and unicodedata.name(c, "").startswith(("LATIN", "FULLWIDTH LATIN"))


_LATIN: dict[str, bool] = {}


def _latin(c: str) -> bool:
    got = _LATIN.get(c)
    if got is None:
        got = _LATIN[c] = is_latin(c)
    return got


def stands_alone(text: str, begin: int, end: int) -> bool:
    """Whether text[begin:end] isn't part of a longer word or number in Latin letters."""
    if begin and _latin(text[begin]) and _latin(text[begin - 1]):
        return False
    return not (end < len(text) and _latin(text[end - 1]) and _latin(text[end]))


def units(folded: str) -> int:
    """A record's length: words, and characters of scripts without spaces."""
    return sum(len(r) if _UNSPACED.match(r) else 1 for r in _RUN.findall(folded))


def all_terms(folded: str, grams: tuple[int, ...] | None = None) -> Counter:
    """Every term of a folded text with its count; with ``grams`` only the n-grams of these lengths and the words."""
    out: Counter = Counter()
    for r in _RUN.findall(folded):
        if _UNSPACED.match(r):
            for n in GRAMS if grams is None else grams:
                out.update(r[i : i + n] for i in range(len(r) - n + 1))
            if grams is None and len(r) > GRAMS[-1]:
                out[r] += 1
        else:
            out[r] += 1
    return out


_BASE = 0x9E3779B97F4A7C15


def _spread_bits(h: np.ndarray) -> Iterator[Callable[[np.ndarray | slice], np.ndarray]]:
    """The places of hashes in the filter, worked out for those asked for only."""
    for i in range(FILTER_HASHES):
        odd = np.uint64((0xBF58476D1CE4E5B9 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF)
        yield lambda at, odd=odd: ((h[at] ^ (h[at] >> np.uint64(29))) * odd) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)


class Roller:
    """Hashes of all substrings of a length, as polynomials over the code points modulo 2 ** 64."""

    def __init__(self) -> None:
        self.powers = self.back = np.ones(1, np.uint64)

    def prefix(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(7)
        while len(self.powers) <= len(codes):
            grown = np.empty(2 * len(self.powers) + len(codes), np.uint64)
            grown[0] = 1
            grown[1:] = _BASE
            self.powers = np.multiply.accumulate(grown)
        return np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(codes * self.powers[: len(codes)])])

    def inverse(self, n: int) -> np.ndarray:
        """base ** -i for i below n; the base is odd and has an inverse."""
        if len(self.back) < n:
            steps = np.full(2 * n, pow(_BASE, -1, 1 << 64), np.uint64)
            steps[0] = 1
            self.back = np.multiply.accumulate(steps)
        return self.back[:n]

    def between(self, prefix: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The hashes of the n characters from each place."""
        return (prefix[at + n] - prefix[at]) * self.inverse(len(prefix))[at]

    def everywhere(self, prefix: np.ndarray, n: int) -> np.ndarray:
        """The hashes of the n characters from every place that has as many."""
        return (prefix[n:] - prefix[:-n]) * self.inverse(len(prefix) - n)


def hash_of(term: str, roller: Roller) -> int:
    return int(roller.prefix(term)[-1])


#: Terms of at least so many characters are looked for only where the filter knows their first ones.
FIRST = 4
_FIRST_SALT = 0x5851F42D4C957F2D


def _passing(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The indexes of the hashes that the filter lets through; each of its hashes thins out what the next one looks at."""
    keep: np.ndarray | None = None
    for place_of in _spread_bits(h):
        here = place_of(slice(None) if keep is None else keep)
        ok = np.flatnonzero((bits[here >> np.uint64(5)] >> (here & np.uint64(31)).astype(np.uint32)) & np.uint32(1))
        keep = ok if keep is None else keep[ok]
        if not len(keep):
            break
    return keep


def filtered(texts: list[str], lengths: list[int], bits: np.ndarray, roller: Roller) -> list[Counter]:
    """Of each folded text the substrings that may be terms of the vocabulary, by the filter, with their counts."""
    out: list[Counter] = [Counter() for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    prefix = roller.prefix("".join(texts))
    begins = np.cumsum(sizes) - sizes
    ends = np.repeat(begins + sizes, sizes)
    likely: np.ndarray | None = None

    def whole_pass(n: int, salt: int = 0) -> np.ndarray:
        if len(ends) < n:
            return np.zeros(0, np.int64)
        at = _passing(roller.everywhere(prefix, n) ^ np.uint64(salt), bits)
        return at[at + n <= ends[at]]

    for n in lengths:
        if n < FIRST:
            at = whole_pass(n)
        else:
            if likely is None:
                likely = whole_pass(FIRST, _FIRST_SALT)
            at = likely[likely + n <= ends[likely]]
            at = at[_passing(roller.between(prefix, at, n), bits)]
        for i, k in zip(at.tolist(), (np.searchsorted(begins, at, "right") - 1).tolist(), strict=True):
            text, j = texts[k], i - int(begins[k])
            if stands_alone(text, j, j + n):
                out[k][text[j : j + n]] += 1
    return out


def vocabulary_filter(vocabulary: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The filter of a vocabulary (term) and the lengths of its terms; both are bounded by the filter's size and the longest term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for b in batches:
            words = b.column(0).to_pylist()
            h = np.fromiter((hash_of(w, roller) for w in words), np.uint64, len(words))
            first = np.fromiter((hash_of(w[:FIRST], roller) for w in words if len(w) >= FIRST), np.uint64) ^ np.uint64(_FIRST_SALT)
            places = np.concatenate([place_of(slice(None)) for x in (h, first) for place_of in _spread_bits(x)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places >> 5), pa.array(np.int64(1) << (places & 31))], names=["at", "bit"])

    cells = vocabulary.select("term").mapInArrow(run, "at bigint, bit bigint").groupBy("at").agg(F.expr("bit_or(bit)").alias("bit")).toPandas()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[cells["at"].to_numpy(np.int64)] = cells["bit"].to_numpy(np.int64).astype(np.uint32)
    return bits, sorted(r.n for r in vocabulary.select(F.char_length("term").alias("n")).distinct().collect())


def term_counts(records: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(record_id, dl, terms: array of term and tf) of records (record_id, text), one row each, so that repeated rows
    are found by their ids alone. ``vocabulary`` has a column ``term`` of folded terms; a few terms outside it may come along."""
    spark = records.sparkSession
    ship(spark)
    every = vocabulary is None
    sent = spark.sparkContext.broadcast(None if every else vocabulary_filter(vocabulary.where("term is not null and term != ''").select("term").distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        bits, lengths = sent.value or (None, None)
        for b in (part.slice(i, 128) for part in batches for i in range(0, part.num_rows, 128)):  # bounds the counts in memory
            sizes, at, found_terms, tfs = [], [0], [], []
            texts = [fold(t or "") for t in b.column(1).to_pylist()]
            for text, counts in zip(texts, map(all_terms, texts) if every else filtered(texts, lengths, bits, roller), strict=True):
                sizes.append(units(text))
                found_terms += counts.keys()
                tfs += counts.values()
                at.append(len(found_terms))
            found = pa.StructArray.from_arrays([pa.array(found_terms, pa.string()), pa.array(tfs, pa.int64())], names=["term", "tf"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), found)], names=["record_id", "dl", "terms"])

    source = records.where("record_id is not null").select(F.col("record_id").cast("string"), "text")
    return spread(source).mapInArrow(run, "record_id string, dl bigint, terms array<struct<term:string,tf:bigint>>").dropDuplicates(["record_id"])


def exploded(counts: DataFrame) -> DataFrame:
    """(record_id, dl, term, tf) from the rows of ``term_counts``."""
    return counts.select("record_id", "dl", F.explode("terms").alias("t")).select("record_id", "dl", "t.term", "t.tf")


def glsq(tf: Column, dl: Column, occurrences: Column, n: Column, avgdl: Column, c: float = C) -> Column:
    """The score G L 2 of one term in one record."""
    lam = occurrences / n
    tfn = tf * F.log2(1 + c * avgdl / dl)
    return (tfn * F.log2((1 + lam) / lam) + F.log2(1 + lam)) / (tfn + 1)


def scored(counts: DataFrame, wanted: DataFrame, c: float = C) -> DataFrame:
    """``wanted`` rows (record_id, dl, term, tf, ...) with their score, by the statistics of all ``counts``."""
    whole = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    f = counts.select(F.explode("terms").alias("t")).groupBy("t.term").agg(F.sum("t.tf").alias("occurrences"))
    f = f.join(F.broadcast(whole))  # one row of statistics beside each term
    score = glsq(F.col("tf"), F.col("dl"), F.col("occurrences"), F.col("n"), F.col("avgdl"), c).alias("score")
    return wanted.join(f, "term").select(*wanted.columns, score)


def scores(records: DataFrame, vocabulary: DataFrame | None = None, c: float = C) -> DataFrame:
    """(record_id, term, tf, score) of every term in every record that has it."""
    counts = term_counts(records, vocabulary).persist(StorageLevel.MEMORY_AND_DISK)
    wanted = exploded(counts)
    if vocabulary is not None:
        wanted = wanted.join(vocabulary.select("term").distinct(), "term", "left_semi").select("record_id", "dl", "term", "tf")
    return scored(counts, wanted, c).select("record_id", "term", "tf", "score")


def distinctive(probes: DataFrame, records: DataFrame, c: float = C) -> DataFrame:
    """(probe_id, term): of each probe (probe_id, record_id, candidates) the candidate with the highest score in its
    record; probes none of whose candidates occur there give no row."""
    ship(probes.sparkSession)

    @F.pandas_udf("string")
    def folded(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: fold(t) if t is not None else None)

    asked = probes.dropDuplicates(["probe_id"]).select("probe_id", "record_id", F.explode("candidates").alias("candidate")).where("candidate is not null")
    asked = asked.withColumn("term", folded("candidate")).persist(StorageLevel.MEMORY_AND_DISK)
    counts = term_counts(records, asked.select("term")).persist(StorageLevel.MEMORY_AND_DISK)
    terms = exploded(counts.join(asked.select("record_id").distinct(), "record_id", "left_semi"))
    found = scored(counts, asked.join(terms, ["record_id", "term"]).select("probe_id", "candidate", "term", "tf", "dl"), c)
    best = Window.partitionBy("probe_id").orderBy(F.desc("score"), "candidate")
    return found.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("probe_id", F.col("candidate").alias("term"))
