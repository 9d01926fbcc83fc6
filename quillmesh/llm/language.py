"""Problem 9: the language of each document and of each stretch in another language, with a confidence.

Method: hyperdimensional profiles. Each letter has a random vector of +1 and -1 (from a hash of the letter), the letters
of an n-gram are permuted by their place and bound by multiplication, the n-grams of a text are bundled by
addition, and the bundle is compared with the prototypes of the languages by cosine. A bundle's product with a prototype is the
sum of its n-grams' products, so each n-gram meets the prototypes once and is remembered, and the bundles of all sentences of many documents
are one sum over a table; the length of a bundle follows from the near-orthogonality of its n-grams. Prototypes are bundles of labelled documents, the mean of
all languages taken off.

Prototypes are trained on at most ``TRAIN_PER_LANGUAGE`` labelled documents a language (by hash of their ids; the
only bounded sample here), twice: the second time on the sentences that the first prototypes agree about, since labels
may be wrong. Every document is classified: its sentences (problem 5) are scored each, and the best path through
the languages is taken in which a change of language must be worth ``SWITCH``. Code, numbers, acronyms and time stamps say
nothing about a language. A document's language is that of most of its sentences, then of most of their letters.

Null, empty and blank texts and texts without a sentence of a language have null language and confidence 0.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.lookalike import plain
from quillmesh.llm.sentences import sentence_spans
from quillmesh.session import ship, spread

LANGUAGES = ("zh", "en", "de", "fr", "es", "pt", "ja", "ru", "ko", "th", "hi")
NO_LABEL = ("", "und", "unknown")
DIMENSIONS = 2048
TRAIN_PER_LANGUAGE = 400
SWITCH = 0.06
LEAST_LETTERS = 4
#: Letters that a sentence in Latin, Greek or Cyrillic must have to count as one.
WHOLE_LETTERS = 10
#: The table of n-grams that a worker remembers: at most so many, of some 50 bytes.
SLOT_BITS, WAYS = 20, 4
SLOTS = 1 << SLOT_BITS
#: Documents scored at once.
AT_ONCE = 256
#: Calls, names with underscores, addresses, dotted words, time stamps, numbers, acronyms, hyphens at line ends; possessive, so that a word is read once.
_NOISE = re.compile(r"(?<![A-Za-z])[A-Za-z]\w*+\([^()\0]{0,60}\)|\b[^\W_]*+_\w*+|https?://\S+|\b\w++(?:\.\w++)++|\[\d+:\d+\]|\b[^\W\d]*+\d\w*+|\b[A-Z][a-z]*+[A-Z]\w*+|(?<=[A-Za-zÀ-ÿ])[-‐¬­]\s*\n\s*")
_ALPHABETS = re.compile("[a-zß-ÿͰ-ӿ]")
_WORDS = re.compile(r"(?:(?![\d_])\w|[̀-ͯऀ-ःऺ-ॏ॑-ॗॢॣัิ-ฺ็-๎])+")


def letters_of(text: str) -> str:
    """The words of a text that speak for a language, between single spaces, in lower case."""
    return words_of([text])[0]


def words_of(parts: list[str]) -> list[str]:
    """``letters_of`` each part; all parts are cleaned in one go."""
    clean = _NOISE.sub(lambda m: "" if "\n" in m[0] and "(" not in m[0] else " ", plain(_BETWEEN.join(p.replace("\0", " ") for p in parts))).casefold()
    return [" ".join(_WORDS.findall(p)) for p in clean.split("\0")]


_BETWEEN = " \0 "


def gram_codes(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, code) of all n-grams of padded sentences in no order: up to three code points of 21 bits in one number. The blank
    alone is no n-gram."""
    codes = np.frombuffer("\0".join(f" {w} " if w else "" for w in sentences).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    border = codes == 0
    at = np.cumsum(border).astype(np.int64)
    one = ~border & (codes != 32)
    two = ~(border[:-1] | border[1:])
    three = two[:-1] & ~border[2:]
    pairs = codes[:-1] | codes[1:] << 21
    triples = pairs[:-1] | codes[2:] << 42
    return np.concatenate([at[one], at[:-1][two], at[:-2][three]]), np.concatenate([codes[one], pairs[two], triples[three]])


def letters_in(code: int) -> str:
    return "".join(chr(c) for i in (0, 21, 42) if (c := code >> i & 0x1FFFFF))


class Space:
    """Letter vectors, bound n-grams, and a table of fixed size with the products of n-grams with prototypes."""

    def __init__(self, prototypes: np.ndarray | None = None, d: int = DIMENSIONS) -> None:
        self.d, self.prototypes = d, prototypes
        self.letters: dict[str, np.ndarray] = {}
        self.tags = np.zeros(SLOTS, np.int64)
        self.table = np.zeros((SLOTS, 0 if prototypes is None else len(prototypes)), np.float32)

    def letter(self, c: str) -> np.ndarray:
        v = self.letters.get(c)
        if v is None:
            seed = int.from_bytes(hashlib.blake2b(c.encode("utf-8", "replace"), digest_size=8).digest(), "big")
            v = np.random.default_rng(seed).integers(0, 2, self.d, dtype=np.int8) * 2 - 1
            if len(self.letters) > 50_000:
                self.letters.clear()
            self.letters[c] = v
        return v

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of n-grams, one row each: letters permuted by their distance from the end and multiplied."""
        out = np.ones((len(codes), self.d), np.int8)
        size = np.where(codes >> 42 > 0, 3, np.where(codes >> 21 > 0, 2, 1))
        for i in range(3):
            letter = codes >> 21 * i & 0x1FFFFF
            for n in range(i + 1, 4):
                rows = np.flatnonzero(size == n)
                if len(rows):
                    used, which = np.unique(letter[rows], return_inverse=True)
                    vectors = np.stack([np.roll(self.letter(chr(c)), n - 1 - i) for c in used.tolist()])
                    out[rows] *= vectors[which]
        return out

    def bundle(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weighted sums of n-grams: one row for each row of ``weights``."""
        out = np.zeros((len(weights), self.d))
        for i in range(0, len(codes), 2048):
            out += weights[:, i : i + 2048] @ self.bound(codes[i : i + 2048]).astype(np.float32)
        return out

    def _met(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), len(self.prototypes)), np.float32)
        for i in range(0, len(codes), 2048):
            out[i : i + 2048] = self.bound(codes[i : i + 2048]).astype(np.float32) @ self.prototypes.T
        return out

    def _found(self, codes: np.ndarray) -> np.ndarray:
        """The slot of each code, -1 where it isn't in the table."""
        home = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) & ~(WAYS - 1)
        out = np.full(len(codes), -1, np.int64)
        for w in range(WAYS):
            out = np.where(self.tags[home + w] == codes, home + w, out)
        return out

    def products(self, codes: np.ndarray) -> np.ndarray:
        """For each n-gram its products with the prototypes. New ones are put into the table, in the place of old ones where it is full."""
        slot = self._found(codes)
        missing = slot < 0
        if not missing.any():
            return self.table[slot]
        new = np.unique(codes[missing])
        met = self._met(new)
        home = (new.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) & ~(WAYS - 1)
        for w in range(WAYS):
            free = np.flatnonzero((self.tags[home + w] == 0) | (w == WAYS - 1))
            places, first = np.unique(home[free] + w, return_index=True)
            self.tags[places], self.table[places] = new[free[first]], met[free[first]]
            left = np.ones(len(new), bool)
            left[free[first]] = False
            new_left, met_left, home_left = new[left], met[left], home[left]
            if w == WAYS - 1 or not len(new_left):
                break
            new, met, home = new_left, met_left, home_left
        slot = self._found(codes)
        out = self.table[slot]
        missing = slot < 0
        if missing.any():
            again, which = np.unique(codes[missing], return_inverse=True)
            out[missing] = self._met(again)[which]
        return out

    def cosines(self, sentences: list[str]) -> np.ndarray:
        """The cosines of the sentences' bundles with the prototypes, all at once. The length of a bundle follows from the
        near-orthogonality of its n-grams."""
        out = np.zeros((len(sentences), len(self.prototypes)), np.float32)
        at, codes = gram_codes(sentences)
        if not len(codes):
            return out
        order = np.lexsort((codes, at)) if len(codes) < 64 else _order(at, codes)
        at, codes = at[order], codes[order]
        begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (codes[1:] != codes[:-1])]))
        count = np.diff(np.append(begin, len(codes))).astype(np.float32)
        at, codes = at[begin], codes[begin]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sums = np.add.reduceat(self.products(codes) * count[:, None], starts, axis=0)
        lengths = np.sqrt(self.d * np.add.reduceat(count * count, starts))
        out[at[starts]] = sums / lengths[:, None]
        return out


def _order(at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """An order in which equal n-grams of a sentence stand together: by sentence and a hash of the n-gram."""
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(22)
    return np.argsort((at.astype(np.uint64) << np.uint64(42)) | h)


def normal_label(label: Column) -> Column:
    """The language code a label names: region, script and case variants go; null where there is no label."""
    code = F.lower(F.regexp_extract(F.trim(label), "^([A-Za-z]+)", 1))
    return F.when(label.isNull() | code.isin(*NO_LABEL), None).otherwise(code)


def sample_of(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """The training documents (label, text): per language those with the least hash of their id."""
    rows = documents.select(normal_label(F.col("lang")).alias("label"), "text", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.col("doc_id").alias("i")).where(F.col("label").isin(*LANGUAGES) & (F.char_length(F.trim("text")) > 0))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h", "i"))).where(F.col("n") <= per_language).select("label", "text")


def centred(sums: dict[str, np.ndarray]) -> np.ndarray:
    """Prototypes of unit length in the order of LANGUAGES, the mean of those present taken off; zero for a language without rows."""
    found = {k: v / np.linalg.norm(v) for k, v in sums.items() if v.any()}
    if not found:
        return np.zeros((len(LANGUAGES), DIMENSIONS), np.float32)
    mean = np.mean(list(found.values()), axis=0) if len(found) > 1 else 0
    out = np.zeros((len(LANGUAGES), DIMENSIONS))
    for i, k in enumerate(LANGUAGES):
        if k in found:
            v = found[k] - mean
            out[i] = v / np.linalg.norm(v)
    return out.astype(np.float32)


def train(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> np.ndarray:
    """The prototypes; only the sums by language come to the driver."""
    spark = documents.sparkSession
    ship(spark)
    sample = sample_of(documents, per_language).cache()

    def summed(first: np.ndarray | None) -> np.ndarray:
        sent = spark.sparkContext.broadcast(first)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            space = Space(sent.value)
            weights: dict[str, Counter] = {}
            for f in frames:
                for label, text in zip(f["label"], f["text"], strict=True):
                    words = [w for _, _, w in sentence_words(text) if len(w) >= LEAST_LETTERS]
                    if not words:
                        continue
                    if sent.value is not None:
                        agreed = space.cosines(words).argmax(axis=1)
                        words = [w for w, k in zip(words, agreed.tolist(), strict=True) if LANGUAGES[k] == label]
                    own = weights.setdefault(label, Counter())
                    at, codes = gram_codes(words) if words else (np.zeros(0, int), np.zeros(0, int))
                    each, count = np.unique(np.stack([at, codes]), axis=1, return_counts=True)
                    for g, n in zip(each[1].tolist(), np.sqrt(count).tolist(), strict=True):
                        own[g] += n
            if weights:
                codes = np.array(sorted(set().union(*weights.values())), np.int64)
                table = np.array([[own[g] for g in codes.tolist()] for own in weights.values()], np.float32)
                yield pd.DataFrame({"label": list(weights), "v": space.bundle(codes, table).tolist()})

        parts = spread(sample).mapInPandas(run, "label string, v array<double>")
        total = parts.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
        rows = total.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect()  # at most one row a language
        return centred({r.label: np.array([x.x for x in r.v]) for r in rows})

    out = summed(summed(None))
    sample.unpersist()
    return out


def best_path(scores: np.ndarray, switch: float = SWITCH) -> list[int]:
    """The languages of consecutive sentences with the highest sum of scores, each change costing ``switch``."""
    n, k = scores.shape
    total, back = scores[0].copy(), np.zeros((n, k), int)
    for t in range(1, n):
        jump = int(np.argmax(total))
        stay = total >= total[jump] - switch
        back[t] = np.where(stay, np.arange(k), jump)
        total = np.where(stay, total, total[jump] - switch) + scores[t]
    path = [int(np.argmax(total))]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    return path[::-1]


def sentence_words(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, words) of the sentences of a text."""
    spans = sentence_spans(text)
    return [(a, b, w) for (a, b), w in zip(spans, words_of([text[a:b] for a, b in spans]), strict=True)] if spans else []  # type: ignore[index]


def segments_of(texts: list[str | None], space: Space) -> list[list[dict]]:
    """Of each text its stretches of one language: start, end, lang, sentences, letters, confidence. All sentences meet the prototypes at once."""
    kept: list[tuple[int, int, int, int, int]] = []  # text, start, end, letters, whether a whole sentence
    words: list[str] = []
    for i, text in enumerate(texts):
        for a, b, w in sentence_words(text):
            size = sum(map(str.isalpha, w))
            if size >= LEAST_LETTERS or size and any(unicodedata.east_asian_width(c) == "W" for c in w):
                kept.append((i, a, b, size, int(size >= WHOLE_LETTERS or not _ALPHABETS.search(w))))
                words.append(w)
    out: list[list[dict]] = [[] for _ in texts]
    if not kept:
        return out
    scores = space.cosines(words)
    of, sizes = np.array([k[0] for k in kept]), np.array([k[3] for k in kept])
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    stops = np.append(starts[1:], len(of))
    chosen = scores.argmax(axis=1)
    same = np.maximum.reduceat(chosen, starts) == np.minimum.reduceat(chosen, starts)
    for a, b in zip(starts[~same].tolist(), stops[~same].tolist(), strict=True):  # one language throughout needs no path
        chosen[a:b] = best_path(scores[a:b] * np.minimum(1.0, sizes[a:b] / 20.0)[:, None])
    own = np.take_along_axis(scores, chosen[:, None], 1)[:, 0]
    masked = scores.copy()
    np.put_along_axis(masked, chosen[:, None], -np.inf, 1)
    other = masked.max(axis=1)
    sure = np.clip(0.5 + (own - other) / (2 * np.maximum(np.maximum(np.abs(own), np.abs(other)), 1e-9)), 0, 1).tolist()
    for (i, a, b, size, one), lang, confidence in zip(kept, chosen.tolist(), sure, strict=True):
        mine = out[i]
        if mine and mine[-1]["lang"] == LANGUAGES[lang]:
            s = mine[-1]
            s["confidence"] = (s["confidence"] * s["letters"] + confidence * size) / (s["letters"] + size)
            s["end"], s["sentences"], s["letters"] = b, s["sentences"] + one, s["letters"] + size
        else:
            mine.append({"start": a, "end": b, "lang": LANGUAGES[lang], "sentences": one, "letters": size, "confidence": confidence})
    return out


_SEGMENT = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("sentences", pa.int64()), ("letters", pa.int64()), ("confidence", pa.float64())])
_SEGMENT_DDL = "array<struct<start:bigint,end:bigint,lang:string,sentences:bigint,letters:bigint,confidence:double>>"


def with_segments(documents: DataFrame, prototypes: np.ndarray) -> DataFrame:
    """(doc_id, label, segments) of every document."""
    spark = documents.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(sent.value)
        for b in (part.slice(i, AT_ONCE) for part in batches for i in range(0, part.num_rows, AT_ONCE)):
            got = pa.array(segments_of(b.column(2).to_pylist(), space), pa.list_(_SEGMENT))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), got], names=["doc_id", "label", "segments"])

    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("lang").alias("label"), "text")
    return spread(rows).mapInArrow(run, f"doc_id bigint, label string, segments {_SEGMENT_DDL}")


def by_language(found: DataFrame) -> DataFrame:
    """(doc_id, label, lang, sentences, letters, confidence, place): place 1 is the document's main language."""
    each = found.select("doc_id", "label", F.explode("segments").alias("s")).select("doc_id", "label", "s.*")
    sums = each.groupBy("doc_id", "label", "lang").agg(F.sum("sentences").alias("sentences"), F.sum("letters").alias("letters"), (F.sum(F.col("confidence") * F.col("letters")) / F.sum("letters")).alias("confidence"))
    place = Window.partitionBy("doc_id").orderBy(F.desc("sentences"), F.desc("letters"), "lang")
    return sums.withColumn("place", F.row_number().over(place))


def languages(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """(doc_id, label, lang, confidence) of every document; null and 0 where there is no sentence of a language."""
    found = with_segments(documents, train(documents, per_language)).persist()
    main = by_language(found).where("place = 1").select("doc_id", "lang", "confidence")
    return found.select("doc_id", "label").join(main, "doc_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def segments(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """(doc_id, start_pos, end_pos, lang, sentences, confidence) of every stretch."""
    found = with_segments(documents, train(documents, per_language))
    return found.select("doc_id", F.explode("segments").alias("s")).selectExpr("doc_id", "s.start as start_pos", "s.end as end_pos", "s.lang", "s.sentences", "s.confidence")


def label_cases(documents: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """(doc_id, kind, lang): missing labels, wrong labels, and further languages with two whole sentences or more."""
    ranked = by_language(with_segments(documents, train(documents, per_language)))
    named = normal_label(F.col("label"))
    kind = F.when(F.col("place") > 1, F.when(F.col("sentences") >= 2, "mixed")).when(named.isNull(), "missing").when(named != F.col("lang"), "wrong")
    return ranked.select("doc_id", kind.alias("kind"), "lang").where("kind is not null")
