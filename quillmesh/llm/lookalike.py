"""Problem 3: one form for texts that look the same but differ in their characters.

First a plain normalisation of each text: invisible characters go, thin and fixed spaces become spaces, width
forms of letters and digits, ligatures, Kangxi and CJK radicals and non-breaking hyphens become the usual
characters, and accents are composed (NFC). Raised digits, case, accents, punctuation and all other
compatibility characters stay, since a reader can tell them apart.

Then script-aware repair, the method: the dominant script of each token of Latin, Greek and Cyrillic letters is
determined, and look-alikes are substituted only in tokens of mixed script, and only where the result
exists in the vocabulary of the corpus. A token that consists of look-alikes of one other script throughout (a short
word or acronym) counts as mixed with its text: it is repaired if the text has no unmistakable letter of the
token's script, or mostly letters of the other one, and the result is at least as frequent a word in texts of that script.

The vocabulary covers the tokens of all texts and stays distributed; suspicious tokens are joined with it by
shuffle. Null texts and null ids give no rows; empty texts stay empty. Repeated rows of a record count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import ship, spread

LEAST_CHARS = 40
#: Invisible format characters.
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
#: CJK radicals without a decomposition and their ideographs.
RADICALS = dict(
    zip(
        "⺁⺄⺅⺆⺈⺉⺌⺍⺎⺒⺓⺔⺕⺖⺘⺙⺛⺜⺝⺞⺠⺡⺢⺣⺤⺥⺦⺧⺨⺩⺪⺫⺬⺭⺮⺯⺰⺱⺲⺶⺷⺹⺺⺼⺾⺿⻀⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻍⻎⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻲",
        "厂乙亻冂刀刂小小兀巳幺彑彐忄扌攵旡日月歺民氵氺灬爫爫丬牛犭王疋目示礻竹糹纟罓罒羊羊耂肀月艹艹艹虎衤覀西见角讠贝车辶辶辶钅長镸长门阝雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙亀",
        strict=True,
    )
)
#: Letters of other scripts that look like Latin ones.
CYRILLIC = dict(zip("аеорсухѕіјһԁԛԝАВЕКМНОРСТХЅІЈУԚԜ", "aeopcyxsijhdqwABEKMHOPCTXSIJYQW", strict=True))
GREEK = dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oABEZHIKMNOPTYX", strict=True))
TO_LATIN = CYRILLIC | GREEK
FROM_LATIN = {"C": {v: k for k, v in CYRILLIC.items()}, "G": {v: k for k, v in GREEK.items()}}


def _plain_table() -> dict[int, str | None]:
    out: dict[int, str | None] = {ord(c): None for c in INVISIBLE}
    for i in [*range(0xA0, 0x3100), *range(0xF900, 0xFB50), *range(0xFF00, 0xFFF0)]:
        c = chr(i)
        name, kind = unicodedata.name(c, ""), unicodedata.category(c)
        tag = unicodedata.decomposition(c).partition(">")[0]
        form = unicodedata.normalize("NFKC", c)
        if kind == "Zs":
            out[i] = " "
        elif tag in ("<wide", "<narrow") and unicodedata.category(form[0])[0] in "LNM":
            out[i] = form
        elif tag == "<compat" and ("LIGATURE" in name or name.startswith(("KANGXI RADICAL", "CJK RADICAL"))):
            out[i] = form
    return out | {0x2010: "-", 0x2011: "-"} | {ord(k): v for k, v in RADICALS.items()}


PLAIN = _plain_table()
_ODD = re.compile("[" + "".join(re.escape(chr(i)) for i in PLAIN) + "]")
_OTHER = re.compile("[Ͱ-ϿЀ-ԯἀ-῿]")
_TOKEN = re.compile("[A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿͰ-ϿЀ-ԯἀ-῿](?:[A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿͰ-ϿЀ-ԯἀ-῿]|[̀-ͯ])*")


def plain(text: str) -> str:
    """The normalisation that needs no context."""
    if _ODD.search(text):
        text = text.translate(PLAIN)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def script(c: str) -> str:
    """L, C or G; empty for marks."""
    if c < "Ͱ" or "Ḁ" <= c <= "ỿ":
        return "" if "̀" <= c <= "ͯ" else "L"
    return "C" if "Ѐ" <= c <= "ԯ" else "G"


def counted(text: str) -> Counter:
    return Counter(s for c in text if (s := script(c)))


def into(token: str, to: str) -> str | None:
    """The token with every letter of another script replaced by its look-alike in ``to``; None if one has none."""
    out = []
    for c in unicodedata.normalize("NFD", token):
        s = script(c)
        if s in ("", to):
            out.append(c)
            continue
        latin = c if s == "L" else TO_LATIN.get(c)
        got = latin if to == "L" or latin is None else FROM_LATIN[to].get(latin)
        if got is None:
            return None
        out.append(got)
    return unicodedata.normalize("NFC", "".join(out))


def context(own: dict[str, Counter], tokens: Counter) -> tuple[str, Counter]:
    """The script a text is written in and its letters by script, from the tokens that can be of one script only;
    Latin where there are none."""
    sure: Counter = Counter()
    for t, n in tokens.items():
        if len(own[t]) == 1:
            s = next(iter(own[t]))
            if all(into(t, o) is None for o in "LCG" if o != s):
                sure[s] += n * sum(own[t].values())
    return max("LCG", key=lambda x: (sure[x], x == "L")), sure


def suspicious(text: str) -> tuple[str, list[tuple[str, list[str]]]]:
    """The text's script, and its distinct tokens that may hold look-alikes, each with its possible repairs, the
    dominant script's first."""
    if not _OTHER.search(text):
        return "L", []
    tokens = Counter(_TOKEN.findall(text))
    own = {t: counted(t) for t in tokens}
    to, sure = context(own, tokens)
    out = []
    for t in tokens:
        scripts = own[t]
        if len(scripts) > 1:
            found = [r for s, _ in sorted(scripts.items(), key=lambda x: (-x[1], x[0] != "L")) if (r := into(t, s)) is not None]
        else:
            s = next(iter(scripts))
            if sure[s] and sure[s] * 2 >= sum(sure.values()):
                continue
            found = [r] if to != s and (r := into(t, to)) is not None else []
        if found:
            out.append((t, list(dict.fromkeys(found))))
    return to, out


def repaired(text: str, repairs: dict[str, str]) -> str:
    return _TOKEN.sub(lambda m: repairs.get(m[0], m[0]), text) if repairs else text


FLUSH = 100_000


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, context, n): all tokens of one script in any texts, folded in case, with their occurrences in texts of
    each script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found: dict[str, Counter]) -> pa.RecordBatch:
            rows = [(w, c, n) for c, words in found.items() for w, n in _folded(words).items()]
            words, contexts, counts = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(contexts, pa.string()), pa.array(counts, pa.int64())], names=["word", "context", "n"])

        found: dict[str, Counter] = {"L": Counter(), "C": Counter(), "G": Counter()}
        for b in batches:
            for t in b.column(0).to_pylist():
                form = plain(t)
                words = _TOKEN.findall(form)
                if _OTHER.search(form):
                    tokens = Counter(words)
                    found[context({w: counted(w) for w in tokens}, tokens)[0]].update(tokens)
                else:
                    found["L"].update(words)
            if sum(map(len, found.values())) > FLUSH:
                yield emit(found)
                found = {"L": Counter(), "C": Counter(), "G": Counter()}
        yield emit(found)

    return texts.mapInArrow(run, "word string, context string, n bigint").groupBy("word", "context").agg(F.sum("n").alias("n"))


def _folded(found: Counter) -> Counter:
    out: Counter = Counter()
    for w, n in found.items():
        if w.isascii() or len(counted(w)) == 1:
            out[w.casefold()] += n
    return out


def first_forms(texts: DataFrame) -> DataFrame:
    """(record_kind, id, raw, canon, text, tokens): hashes of the text and of its plain form; for texts with suspicious
    tokens also the plain text and the tokens with their repairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            rows = []
            for kind, i, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                form = plain(t)
                to, odd = suspicious(form)
                raw = t.encode("utf-8", "replace")
                rows.append(
                    {
                        "record_kind": kind, "id": i, "raw": digest(raw), "canon": digest(form.encode("utf-8", "replace")), "text": form if odd else None,
                        "tokens": [{"token": w, "context": to if len(counted(w)) == 1 else "", "folded": w.casefold(), "results": [{"rank": k, "result": r, "folded": r.casefold()} for k, r in enumerate(rs)]} for w, rs in odd] or None,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=_FORMS)

    return texts.mapInArrow(run, _FORMS_DDL)


_RESULT = pa.struct([("rank", pa.int32()), ("result", pa.string()), ("folded", pa.string())])
_FORMS = pa.schema(
    [("record_kind", pa.string()), ("id", pa.string()), ("raw", pa.binary()), ("canon", pa.binary()), ("text", pa.string()), ("tokens", pa.list_(pa.struct([("token", pa.string()), ("context", pa.string()), ("folded", pa.string()), ("results", pa.list_(_RESULT))])))]
)
_FORMS_DDL = "record_kind string, id string, raw binary, canon binary, text string, tokens array<struct<token:string,context:string,folded:string,results:array<struct<rank:int,result:string,folded:string>>>>"


def chosen_repairs(forms: DataFrame, words: DataFrame) -> DataFrame:
    """(record_kind, id, repairs): of the suspicious tokens the repairs that the vocabulary confirms. A token of mixed
    script, whose context is empty, is confirmed by texts of any script, one all of look-alikes by texts of its context."""
    each = forms.where("tokens is not null").select("record_kind", "id", F.explode("tokens").alias("t")).select("record_kind", "id", "t.*")
    options = each.select("token", "context", "results", F.col("folded").alias("own")).distinct().withColumn("r", F.explode("results"))
    options = options.select("token", "context", "results", "own", "r.rank", "r.result", F.col("r.folded").alias("folded"))
    asked = options.select(F.col("folded").alias("word"), "context").union(options.select(F.col("own").alias("word"), "context")).distinct()
    by_context = words.join(asked.select("word").distinct(), "word", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    known = by_context.unionByName(by_context.groupBy("word").agg(F.lit("").alias("context"), F.sum("n").alias("n")))
    options = options.join(known.withColumnsRenamed({"word": "folded"}), ["folded", "context"]).join(known.withColumnsRenamed({"word": "own", "n": "own_n"}), ["own", "context"], "left")
    better = options.where("own_n is null or n >= own_n")  # a mixed token is never in the vocabulary itself
    best = better.withColumn("__n", F.row_number().over(Window.partitionBy("token", "context", "results").orderBy(F.desc("n"), "rank"))).where("__n = 1")
    got = each.join(best.select("token", "context", "results", "result"), ["token", "context", "results"])
    return got.groupBy("record_kind", "id").agg(F.collect_set(F.struct("token", "result")).alias("repairs"))


def apply_repairs(marked: DataFrame) -> DataFrame:
    """(record_kind, id, raw, canon, text) with the repairs made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows = []
            for r in b.to_pylist():
                text = repaired(r["text"], {x["token"]: x["result"] for x in r["repairs"] or []})
                rows.append({"record_kind": r["record_kind"], "id": r["id"], "raw": r["raw"], "canon": xxhash.xxh3_128_digest(text.encode("utf-8", "replace")), "text": text})
            yield pa.RecordBatch.from_pylist(rows, schema=_DONE)

    return marked.mapInArrow(run, "record_kind string, id string, raw binary, canon binary, text string")


_DONE = pa.schema([("record_kind", pa.string()), ("id", pa.string()), ("raw", pa.binary()), ("canon", pa.binary()), ("text", pa.string())])


def normalized(texts: DataFrame) -> DataFrame:
    """(record_kind, id, text): the texts themselves in the consistent form, each id once."""
    ship(texts.sparkSession)
    source = texts.where("text is not null and id is not null").dropDuplicates(["record_kind", "id"])
    forms = first_forms(spread(source)).where("tokens is not null").persist(StorageLevel.MEMORY_AND_DISK)
    fixed = apply_repairs(forms.drop("tokens", "canon").join(chosen_repairs(forms, vocabulary(spread(texts.where("text is not null").select("text")))), ["record_kind", "id"], "left"))

    @F.pandas_udf("string")
    def simple(s):  # noqa: ANN001, ANN202
        return s.map(plain)

    both = source.join(fixed.select("record_kind", "id", F.col("text").alias("__fixed")), ["record_kind", "id"], "left")
    return both.select("record_kind", "id", F.coalesce("__fixed", simple("text")).alias("text"))


def canonical(texts: DataFrame, least_chars: int = 0) -> DataFrame:
    """(record_kind, id, raw, canon) of texts (record_kind, id, text) of at least ``least_chars`` characters, each id
    once: equal ``canon`` means equal looks. The vocabulary is that of all texts."""
    ship(texts.sparkSession)
    words = vocabulary(spread(texts.where("text is not null").select("text")))
    long = texts.where(F.col("id").isNotNull() & (F.char_length("text") >= least_chars)).select("record_kind", "id", "text")
    forms = first_forms(spread(long)).dropDuplicates(["record_kind", "id"]).persist(StorageLevel.MEMORY_AND_DISK)
    odd = forms.where("tokens is not null")
    fixed = apply_repairs(odd.drop("tokens", "canon").join(chosen_repairs(odd, words), ["record_kind", "id"], "left"))
    return forms.where("tokens is null").select("record_kind", "id", "raw", "canon").unionByName(fixed.drop("text"))


def lookalike_pairs(texts: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(record_kind, id_a, id_b), smaller id first: records that look the same but are not the same string. Exact
    copies pair with nothing among themselves; classes without different strings are dropped before the join."""
    long = canonical(texts, least_chars).persist(StorageLevel.MEMORY_AND_DISK)
    key = ["record_kind", "canon"]
    mixed = long.groupBy(*key).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo != hi").select(*key)
    rows = long.join(mixed, key, "left_semi")
    a = rows.select(*key, F.col("raw").alias("raw_a"), F.col("id").alias("id_a"))
    b = rows.select(*key, F.col("raw").alias("raw_b"), F.col("id").alias("id_b"))
    return a.join(b, key).where("raw_a != raw_b and id_a < id_b").select("record_kind", "id_a", "id_b")


def classes(texts: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(record_kind, id, class_id, forms, links) of every record that looks like another one without being the same string: its class by the hash of
    the common form, the number of different strings in it, and the number of records of other strings. Copies aren't expanded into pairs, so a
    class of any size is as many rows as records; counts are made before the rows are shuffled."""
    long = canonical(texts, least_chars).persist(StorageLevel.MEMORY_AND_DISK)
    key = ["record_kind", "canon"]
    strings = long.groupBy(*key, "raw").agg(F.count("*").alias("n"))
    whole = strings.groupBy(*key).agg(F.sum("n").alias("records"), F.count("*").alias("forms")).where("forms > 1")
    counts = strings.join(whole, key).select(*key, "raw", "forms", (F.col("records") - F.col("n")).alias("links"))
    return long.join(counts, [*key, "raw"]).select("record_kind", "id", F.lower(F.hex("canon")).alias("class_id"), "forms", "links")
