"""Problem 7: a column of texts as ids of a public byte-level BPE vocabulary.

Method: contiguous rank array. A word's parts are kept as a list of boundaries beside the list of ranks of
adjacent pairs; the least rank is looked for, its boundary deleted and the two neighbouring ranks refreshed,
until no pair has a rank. Words over ``LONG_WORD`` bytes (base64 dumps, runs without spaces) take the same
merges from a heap, so that one monstrous word does not cost quadratic time.

Null and empty texts give an empty list; blank texts are encoded like any other; strings that look like special
tokens are ordinary text. Ill-formed text can't occur in a Spark string. The vocabulary has a fixed size (a few
MB), so it is broadcast; the word cache of a task is bounded by ``CACHE_WORDS``.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import ship, spread

TOKENIZERS = os.environ.get("QUILLMESH_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published pre-tokenisation pattern of the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 400
CACHE_WORDS = 200_000
NONE = 1 << 30


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by the contiguous rank array."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return _merge_long(word, ranks)
    get = ranks.get
    cuts = list(range(len(word) + 1))
    pair = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while pair:
        least = min(pair)
        if least == NONE:
            break
        i = pair.index(least)
        del cuts[i + 1]
        del pair[i]
        if i < len(pair):
            pair[i] = get(word[cuts[i] : cuts[i + 2]], NONE)
        if i:
            pair[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in the same order (least rank, then leftmost), found by a heap over a linked list."""
    n = len(word)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = after[i]
        if j >= n or after[j] != end:
            continue
        alive[j] = 0
        after[i] = end
        if end < n:
            before[end] = i
            k = after[end]
            if (r := ranks.get(word[i:k])) is not None:
                heapq.heappush(heap, (r, i, k))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


def encoder(ranks: dict[bytes, int]) -> Callable[[str | None], list[int]]:
    """A function from text to ids, with a bounded cache of words."""
    import regex

    words = regex.compile(PATTERN).findall
    cache: dict[str, list[int]] = {}

    def encode(text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        for w in words(text):
            ids = cache.get(w)
            if ids is None:
                ids = merge_word(w.encode("utf-8", "replace"), ranks)
                if len(w) <= 64:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = ids
            out += ids
        return out

    return encode


def encode_column(
    df: DataFrame,
    text: str = "text",
    out: str = "ids",
    lengths_only: bool = False,
    vocabulary: str = "byte_bpe_50k.tiktoken",
    tokenizers: str = TOKENIZERS,
) -> DataFrame:
    """``df`` with the ids of ``text`` in the new column ``out`` in the place of ``text``; with ``lengths_only``
    their number (bigint). Other columns pass through; one already named ``out`` is an error."""
    if out in df.columns and out != text:
        raise ValueError(f"the column {out} exists already")
    spark = df.sparkSession
    ship(spark)
    data = spark.sparkContext.broadcast(Path(tokenizers, vocabulary).read_bytes())
    keep = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` {'bigint' if lengths_only else 'array<int>'}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(read_ranks(data.value))
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            ids: pa.Array
            if lengths_only:
                ids = pa.array([len(encode(t.as_py())) for t in texts], pa.int64())
            else:
                ids = pa.array([encode(t.as_py()) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), ids], names=[*keep, out])

    return spread(df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`"))).mapInArrow(run, schema)
