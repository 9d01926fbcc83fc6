import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import ids, text
from quillmesh.functions.filters import SearchFilters, matches


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("用 户使用 TCP / IP 协议 。", "用户使用 TCP/IP 协议。"),
        ("系统 ， 该系统 （ protocol ） 工作。", "系统，该系统（protocol）工作。"),
        ("1. 1. 1 具体构成描述", "1.1.1 具体构成描述"),
        ("50 %  of\n\ttext", "50% of text"),
        ("", ""),
        (None, None),
    ],
)
def test_normalize_text(spark, raw, want):
    assert one(spark, raw, text.normalize_text) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("ＴＣＰ", ["tcp"]),
        ("RTT RTT", ["rtt", "rtt"]),
        ("HTTP/1.1 使用 IPv4", ["http", "1.1", "使", "用", "ipv4"]),
        ("v1.2.3 1.5.2x 1..2", ["v1", "2.3", "1.5", "2x", "1", "2"]),
        ("？？？", []),
        (None, []),
    ],
)
def test_tokens(spark, raw, want):
    assert one(spark, raw, text.tokens) == want


def test_stopwords(spark):
    assert one(spark, "The TCP the", lambda c: text.tokens(c, ("THE",))) == ["tcp"]


@pytest.mark.parametrize(("raw", "want"), [("Ende.”) ", True), ("Ende", False), ("好。」", False), ("好。】", True), ("", False), (None, False)])
def test_ends_sentence(spark, raw, want):
    assert one(spark, raw, text.ends_sentence) is want


def test_joined_continuation(spark):
    df = spark.createDataFrame([("the ", "network"), ("用于存", "储和"), ("a", "的")], "a string, b string")
    assert [r[0] for r in df.select(text.joined_continuation(F.col("a"), F.col("b"))).collect()] == ["the network", "用于存储和", "a的"]


def test_headings_and_slugs(spark):
    assert one(spark, "2.1.3 Title", text.heading_number) == "2.1.3"
    assert one(spark, "2.1.3", text.heading_level) == 3
    assert one(spark, "第 4 章", text.chapter_marker) == "第4章"
    assert one(spark, "第4章 好", text.chapter_marker) is None
    assert one(spark, "--!!", text.slug) == "heading"
    assert one(spark, "A b/C", text.slug) == "a-b-c"
    assert one(spark, "d = 4 距离", text.formula_prefix) == "d = 4"


def test_replaced_once(spark):
    col = text.replaced_once(F.col("t"), F.col("f"), F.col("b"))
    kind = "t string, f string, b string"
    assert spark.createDataFrame([("a b a", "b", "c")], kind).select(col).first()[0] == "a c a"
    with pytest.raises(Exception, match="exactly once"):
        spark.createDataFrame([("a a", "a", "c")], kind).select(col).collect()


def test_ids(spark):
    df = spark.createDataFrame([("doc", ["章", "a\x1fb"], ["x", "y"], "sha256:1", "1.1.0")], "d string, h array<string>, b array<string>, c string, v string")
    payload = json.dumps({"block_ids": ["x", "y"], "chunking_version": "1.1.0", "content_hash": "sha256:1", "document_id": "doc", "heading_path": ["章", "a\x1fb"]}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    got = df.select(ids.chunk_id(*[F.col(c) for c in "dhbcv"])).first()[0]
    assert got == "sha256:" + hashlib.sha256(payload.encode()).hexdigest()
    for i in range(9):
        assert one(spark, f"abc{i}", lambda c: ids.point_id(c, "some:")) == str(uuid.uuid5(uuid.NAMESPACE_URL, f"some:abc{i}"))
    parts = ["d", "版", "7"]
    framed = b"".join(len(p.encode()).to_bytes(8, "big") + p.encode() for p in parts)
    assert spark.range(1).select(ids.block_id(*[F.lit(p) for p in parts])).first()[0] == "sha256:" + hashlib.sha256(framed).hexdigest()
    assert one(spark, ["第二章", "应用层", "HTTP"], ids.prefix_keys, "array<string>") == ['["第二章"]', '["第二章","应用层"]', '["第二章","应用层","HTTP"]']
    assert one(spark, [], ids.prefix_keys, "array<string>") == []


def test_index_version(spark):
    rows = spark.createDataFrame([(1, "a", ["t", "u"]), (2, "b", ["t"])], "position int, chunk_id string, terms array<string>")
    got = rows.agg(F.sort_array(F.collect_list(F.struct("position", "chunk_id", "terms"))).alias("r")).select(ids.bm25_version(F.col("r"))).first()[0]
    want = hashlib.sha256(b"bm25-index-v1\0" + b"a\0t\0u\0\xff" + b"b\0t\0\xff").hexdigest()
    assert got == f"bm25-v1:{want}"


def test_filters(spark):
    rows = [("a", ["x", "y"], 20, 22), ("a", ["x"], 24, 30), ("b", ["z"], 19, 22), ("c", None, 1, 1)]
    df = spark.createDataFrame(rows, "document_id string, heading_path array<string>, page_start long, page_end long")
    count = lambda **k: df.where(SearchFilters(**k).predicate()).count()
    assert count() == 4
    assert count(page_start=21, page_end=21) == 2
    assert count(page_start=21, page_end=25) == 3
    assert count(document_ids=("a", "b"), heading_prefix=("x",)) == 2
    assert count(heading_prefix=("x", "y")) == 1
    f = F.from_json(F.lit('{"document_ids":["a"],"page_start":23}'), "document_ids array<string>, heading_prefix array<string>, page_start bigint, page_end bigint")
    assert df.where(matches(f, *[F.col(c) for c in df.columns])).count() == 1
    for bad in ({"document_ids": ()}, {"document_ids": ("a", "a")}, {"heading_prefix": (" ",)}, {"page_start": 0}, {"page_start": 5, "page_end": 4}, {"page_start": True}):
        with pytest.raises(ValueError):
            SearchFilters(**bad)


def test_numbers_beside_underscores(spark):
    assert one(spark, "见_7.14_节 7.14 v_2.5.1 2.5", lambda c: text.tokens(c)) == ["见", "7", "14", "节", "7.14", "v", "2", "5.1", "2.5"]
