"""Identity functions by exact byte recipes, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL name space of UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def canonical_json(value: Column) -> Column:
    """Compact JSON; control characters are escaped in lower case, as in the recipe of chunk ids."""
    text = F.to_json(value)
    for code in range(0x1A, 0x20):
        text = F.replace(text, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return F.replace(F.replace(text, F.lit("\\u000B"), F.lit("\\u000b")), F.lit("\\u000E"), F.lit("\\u000e"))


def chunk_id(document_id: Column, heading_path: Column, block_ids: Column, hash_: Column, version: Column) -> Column:
    keys = F.struct(block_ids.alias("block_ids"), version.alias("chunking_version"), hash_.alias("content_hash"), document_id.alias("document_id"), heading_path.alias("heading_path"))
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(keys), 256))


def block_id(*parts: Column) -> Column:
    """SHA-256 over the parts, each after its length as 8 bytes."""
    framed = []
    for p in parts:
        text = p.cast("string")
        framed += [F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0")), F.encode(text, "UTF-8")]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(*framed), 256))


def point_id(chunk: Column, prefix: str = "chunk:") -> Column:
    """UUID version 5 of a chunk id under the URL name space; ``prefix`` is that of the collection to agree with."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(F.concat(F.lit(prefix), chunk), "UTF-8")))
    nibble = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(nibble, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def prefix_keys(path: Column) -> Column:
    """One JSON key for each prefix of a heading path."""
    return F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.to_json(F.slice(path, 1, i)))).otherwise(F.array().cast("array<string>"))


def dense_version(collection: str, embedding_version: str) -> str:
    return f"dense-v1:{collection}:{embedding_version}"


def hybrid_version(bm25: str, dense: str) -> str:
    return f"hybrid-v1:{bm25}|{dense}"


def rerank_version(base: str) -> str:
    return f"{base}|rerank-v1:lexical-overlap"


def embedding_version(provider: str, model: str, dimensions: int, instruction: str) -> str:
    return f"{provider}:{model}:dimensions-{dimensions}:query-v1-{hashlib.sha256(instruction.encode()).hexdigest()[:12]}"


def bm25_version(rows: Column) -> Column:
    """The version of a lexical index from the sorted (position, chunk_id, terms) of all chunks; for small corpora, since
    the digest needs every term in order."""
    zero, end = F.unhex(F.lit("00")), F.unhex(F.lit("FF"))

    def one(r: Column) -> Column:
        body = F.aggregate(r["terms"], F.encode(F.lit(""), "UTF-8"), lambda a, t: F.concat(a, F.encode(t, "UTF-8"), zero))
        return F.concat(F.encode(r["chunk_id"], "UTF-8"), zero, body, end)

    start = F.concat(F.encode(F.lit("bm25-index-v1"), "UTF-8"), zero)
    return F.concat(F.lit("bm25-v1:"), F.sha2(F.aggregate(rows, start, lambda a, r: F.concat(a, one(r))), 256))
