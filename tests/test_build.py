"""Analyser, index checks, whole audits, books."""

import json

import pytest
from pyspark.sql import functions as F

from quillmesh.functions.analyzer import Analyzer
from quillmesh.functions.filters import SearchFilters
from quillmesh.operators import audit, build, dense, lexical, overlay, sinks
from quillmesh.plans.retrievers import Retrievers
from quillmesh.sources import layout
from tests.test_retrieval import ask, corpus

WORDS = {"计算机": 50, "网络": 80, "计算机网络": 30, "协议": 60, "核心": 20, "传输": 30, "可靠": 20, "运输层": 30, "能力": 10, "重要": 20}


def test_words_of_the_dictionary():
    a = Analyzer(WORDS)
    assert a.terms("计算机网络的核心是协议") == ["计算机网络", "的", "核心", "是", "协议"]
    assert a.terms("ＴＣＰ，HTTP/1.1 使用 IPv4。10.0.0.1") == ["tcp", "http", "1.1", "使", "用", "ipv4", "10.0.0.1"]
    assert a.terms(None) == a.terms(" \n\t ") == a.terms("，。") == [] and a.terms("RTT RTT") == ["rtt", "rtt"]
    assert a.terms("ﬁn Straße ⅷ") == ["fin", "strasse", "viii"]
    assert "端到端可靠传输" in Analyzer(WORDS, user_words=["端到端可靠传输"]).terms("端到端可靠传输是运输层的重要能力")
    assert Analyzer(WORDS, stopwords=["ＴＣＰ", "的"]).terms("TCP 的 网络") == ["网络"]
    assert Analyzer().terms("网络") == ["网", "络"]
    with pytest.raises(ValueError):
        Analyzer(user_words=[" "])


def test_path_is_the_likeliest():
    a = Analyzer({"ab": 5, "abc": 50, "cd": 5, "d": 1, "bcd": 9})
    run = "abcd"

    def every(i):
        if i == len(run):
            yield []
        for j in range(i + 1, len(run) + 1):
            if j == i + 1 or run[i:j] in a.counts:
                yield from ([run[i:j], *rest] for rest in every(j))

    def worth(parts):
        out = 1.0
        for p in parts:
            out *= a.counts.get(p, 1) / a.total
        return out

    assert a.segmented("网" + run)[1:] == max(every(0), key=worth)


def test_index_with_a_dictionary(spark):
    index = lexical.build(corpus(spark, ["计算机网络的协议", "网络"]), analyzer=Analyzer(WORDS))
    assert {r.term for r in index.postings.collect()} == {"计算机网络", "的", "协议", "网络"}
    assert [r.chunk_id for r in lexical.search(index, ask(spark, "计算机网络")).collect()] == ["c0"]


@pytest.mark.parametrize(("texts", "reason"), [([], "empty"), (["a", "。"], "no searchable terms")])
def test_unfit_corpora_are_refused(spark, texts, reason):
    chunks = corpus(spark, texts) if texts else corpus(spark, ["a"]).limit(0)
    with pytest.raises(ValueError, match=reason):
        lexical.build(chunks, check=True)
    good = corpus(spark, ["a"])
    with pytest.raises(ValueError, match="repeated"):
        lexical.build(good.unionByName(good), check=True)


def test_ties_in_the_order_of_the_corpus(spark):
    chunks = corpus(spark, ["网络"] * 12).withColumn("ordinal", 100 - F.col("ordinal"))
    r = Retrievers(lexical.build(chunks))
    got = [x.chunk_id for x in r.search("bm25", ask(spark, "网络"), 3).orderBy("rank").collect()]
    assert got == ["c11", "c10", "c9"]
    for sizes in ({"k": 0}, {"k": 5, "leg_k": 500}, {"k": 5, "rrf_k": 0}):
        with pytest.raises(ValueError):
            r.search("bm25", ask(spark, "a"), **sizes)


def test_blocks_of_the_search_agree(spark, monkeypatch):
    chunks = corpus(spark, [f"a {'b ' * (i % 4)}c{i % 3}" for i in range(40)])
    queries = ask(spark, "a b", "c1", "b c2 c2", "zzz")
    whole = {tuple(r) for r in lexical.search(lexical.build(chunks), queries, 7).withColumn("score", F.round("score", 9)).collect()}
    monkeypatch.setattr(lexical, "CHUNK_BLOCK", 6)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 2)
    assert {tuple(r) for r in lexical.search(lexical.build(chunks), queries, 7).withColumn("score", F.round("score", 9)).collect()} == whole


def text(ref, label, content, page, top, **more):
    return {"self_ref": ref, "parent": None, "content_layer": more.get("layer"), "label": label, "prov": [{"page_no": page, "bbox": {"l": 1.0, "t": top, "r": 9.0, "b": top + 5, "coord_origin": "TOPLEFT"}}], "text": content}


def layouts(spark, page=2):
    def one(section, first, title):
        pages = {str(p): {"page_no": p, "size": {"width": 100.0, "height": 100.0}} for p in (first, first + 1)}
        texts = [text("#/texts/0", "section_header", title, first, 1.0), text("#/texts/1", "text", "The host sends a frame.", first, 10.0), text("#/texts/2", "text", "The node waits for it.", first, 20.0), text("#/texts/3", "caption", "Figure one", first + 1, 5.0)]
        return (section, "book.pdf", pages, texts, [{"image": {"uri": "assets/a.png"}, "captions": [{"$ref": "#/texts/3"}]}])

    from quillmesh.sources.schema import LAYOUT

    kinds = {f.name: f.dataType.simpleString() for f in LAYOUT.fields}
    ddl = "section_id string, source_path string, " + ", ".join(f"{c} {kinds[c]}" for c in ("pages", "texts", "pictures"))
    ddl = ddl.replace("$ref:", "`$ref`:")
    return spark.createDataFrame([one("one", 1, "Hosts"), one("two", 3, "Nodes")], ddl)


def manifest(**changes):
    raw = {"schema_version": "1", "book_id": "book", "source_sha256": "ab" * 32, "source_page_count": 4, "sections": [{"section_id": "one", "title": "Hosts", "start_page": 1, "end_page": 2}, {"section_id": "two", "title": "Nodes", "start_page": 3, "end_page": 4}]}
    return build.read_manifest(json.dumps(raw | changes))


def test_manifests():
    assert [s.section_id for s in manifest().selected(["two"])] == ["two"]
    for bad in ({"source_page_count": 3}, {"book_id": "No"}, {"sections": []}, {"extra": 1}):
        with pytest.raises(ValueError):
            manifest(**bad)
    with pytest.raises(ValueError, match="unknown section"):
        manifest().selected(["three"])


def test_books_are_built(spark):
    m = manifest()
    built = build.sections_of(layouts(spark), m, overlays={"one": [overlay.Correction("c1", 1, "replace_text", ("#/texts/1",), "Hosts", "node", "misread", replacement="packet", find_text="frame")]})
    assert {(r.section_id, r.passed, r.error_count) for r in built.results.collect()} == {("one", True, 0), ("two", True, 0)}
    blocks = built.blocks.orderBy("section_id", "ordinal").collect()
    assert [b.text for b in blocks if b.section_id == "one"] == ["Hosts", "The host sends a packet.", "The node waits for it.", "Figure one"]
    assert {b.document_id for b in blocks} == {"sha256:" + "ab" * 32} and {b.image_path for b in blocks if b.text == "Figure one"} == {"assets/a.png"}
    chunks, row = build.corpus_of(built, m)
    facts = json.loads(row.first().manifest)
    assert sorted(r.ordinal for r in chunks.collect()) == list(range(1, facts["indexed_chunk_count"] + 1)) and facts["included_sections"][0]["chunk_count"] == 1
    with pytest.raises(ValueError, match="every section"):
        build.corpus_of(build.sections_of(layouts(spark), m, ["one"]), m)


def test_conflicting_captions_are_errors(spark):
    docs = layouts(spark).withColumn("document_id", F.col("section_id"))
    twice = docs.withColumn("pictures", F.concat("pictures", F.transform("pictures", lambda p: p.withField("image", F.struct(F.lit("assets/b.png").alias("uri"))))))
    with pytest.raises(Exception, match="several pictures"):
        layout.normalized(twice).collect()
    gone = docs.withColumn("pages", F.map_filter("pages", lambda k, _: k.isin("1", "3")))
    with pytest.raises(Exception, match="outside the source"):
        layout.normalized(gone).collect()


def test_whole_audit(spark):
    blocks = spark.createDataFrame([("b1", "d", "Hosts", "paragraph", 1, 1, 1, "assets/a.png"), ("b2", "d", "Nodes", "paragraph", 1, 1, 2, None)], "block_id string, document_id string, text string, block_type string, page_start long, page_end long, ordinal long, image_path string")
    chunks = spark.createDataFrame([("c1", "d", "Hosts", "h Hosts", 1, 1, 1, ["b1", "b2"])], "chunk_id string, document_id string, content string, index_text string, page_start long, page_end long, ordinal long, block_ids array<string>")
    lines = spark.createDataFrame([("d", 1, "<!-- formula-not-decoded -->"), ("d", 2, "x")], "document_id string, line_no bigint, line string")
    files = spark.createDataFrame([("assets/zzz.png",)], "path string")
    a = audit.Artifacts(blocks, chunks, reported_blocks=1, reported_chunks=1, lines=lines, files=files)
    found = audit.full(a).orderBy("stage_no", "document_id", "issue_no").collect()
    assert [r.issue_code for r in found] == ["FORMULA_NOT_DECODED", "TEXT_EXPECTS_MISSING_FORMULA", "REPORT_COUNT_MISMATCH", "MISSING_IMAGE_TARGET"]
    assert all(r.remediation_hint for r in found)
    assert {r.document_id: r.passed for r in audit.report(audit.full(a)).collect()}["d"] is False


def test_vector_table(spark, tmp_path):
    fields = "chunk_id string, document_id string, content string, index_text string, heading_path array<string>, page_start long, page_end long, ordinal long, block_ids array<string>, source_path string, content_hash string, normalization_version string, chunking_version string"
    rows = [(f"c{i}", "d", "t", "t", ["a", "b"] if i else ["a"], 1, 1, i + 1, ["x"], "p", "h", "1", "1") for i in range(3)]
    chunks = spark.createDataFrame(rows, fields)
    table = sinks.VectorTable(spark, str(tmp_path / "v"), 2)
    assert table.create()
    records = sinks.embedded(chunks, lambda texts: [[1.0, float(len(texts))] for _ in texts], 2, "m")
    assert table.upsert(records) == 3 and not table.create()
    queries = spark.createDataFrame([("q", [1.0, 3.0])], "query_id string, values array<double>")
    hits = table.search(queries, 5, SearchFilters(heading_prefix=("a", "b"))).collect()
    assert {r.chunk_id for r in hits} == {"c1", "c2"} and hits[0].block_ids == ["x"]
    with pytest.raises(ValueError):
        sinks.VectorTable(spark, str(tmp_path / "v"), 3).create()
    with pytest.raises(ValueError, match="lacks"):
        dense.restored(table.read().drop("content"))
