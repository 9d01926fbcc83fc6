import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.operators import audit, chunking, corpus, formulas, overlay, sequences, sinks
from quillmesh.operators.chunking import ChunkingConfig, Unit
from quillmesh.sources import jsonl, layout, schema
from quillmesh.streaming import ingest

BLOCK = "block_id string, document_id string, text string, block_type string, heading_path array<string>, page_start long, page_end long, ordinal long, source_path string, image_path string, normalization_version string"


def blocks(spark, *rows):
    """(text, type, page, path) in order."""
    out = [(f"b{i}", "d", t, k, p, a, a, i + 1, "s", None, "1") for i, (t, k, a, p) in enumerate(rows)]
    return spark.createDataFrame(out, BLOCK)


def test_sentence_stops():
    text = "RTT 为 3.14 秒。下一句。"
    assert chunking.sentence_stops(text) == [text.index("。") + 1, len(text)]


def test_splits():
    assert [len(x) for x in chunking.split_to_budget("A" * 200, 96)] == [96, 96, 8]
    two = "甲" * 60 + "。" + "乙" * 60 + "。"
    assert chunking.split_to_budget(two, 96) == ["甲" * 60 + "。", "乙" * 60 + "。"]
    with pytest.raises(ValueError):
        chunking.split_to_budget("a", 0)


def unit(n, c="甲"):
    return Unit(c * n, "paragraph", [f"{c}{n}"], (1, 1))


def test_pack_repeats_whole_units():
    out = chunking.pack([unit(60), unit(26, "乙"), unit(60, "丙")], 2, ChunkingConfig(100, 30))
    assert [[len(u.text) for u in us] for us, _ in out] == [[60, 26], [26, 60]] and out[1][1] == 1


def test_overlap_is_a_sentence_suffix():
    u = Unit("甲" * 40 + "。" + "乙" * 20 + "。", "paragraph", ["x"], (1, 1))
    assert chunking.sentence_suffix(u.text, u.kind, 30) == "乙" * 20 + "。"
    assert chunking.sentence_suffix(u.text, "table", 30) == ""


def test_overlap_does_not_propagate():
    us = [Unit("字" * 40 + "。" + c * 19 + "。", "paragraph", [c], (1, 1)) for c in "甲乙丙"]
    out = chunking.pack(us, 2, ChunkingConfig(100, 25))
    assert len(out) == 3 and "甲" not in {b for u in out[2][0] for b in u.block_ids}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab 。.字\n", min_size=1, max_size=150).filter(str.strip), min_size=1, max_size=12), st.integers(0, 60))
def test_packed_chunks_keep_the_limit_and_all_units(texts, overlap):
    config = ChunkingConfig(100, overlap)
    parts, _, _ = chunking.fitted([Unit(t.strip(), "paragraph", [str(i)], (1, 1)) for i, t in enumerate(texts)], 4, config)
    out = chunking.pack(parts, 4, config)
    assert all(4 + 2 + len(chunking.joined(us)) <= 100 for us, _ in out)
    assert [u.text for us, n in out for u in us[n:]] == [u.text for u in parts]


def test_config_is_checked():
    for bad in ({"max_chars": 99}, {"overlap_chars": 1200}, {"overlap_chars": -1}, {"version": " "}):
        with pytest.raises(ValueError):
            ChunkingConfig(**bad)


def test_chunk_pipeline(spark):
    h = ["章节"]
    b = blocks(spark, ("章节", "section_heading", 1, h), ("这些媒体用于存", "paragraph", 1, h), ("储和传输数据。", "paragraph", 2, h), ("x", "figure_label", 2, h), ("T" * 120, "table", 2, h), ("空" * 60 + "。" + "满" * 61 + "。", "paragraph", 2, h))
    got = chunking.chunks(b, ChunkingConfig(100, 0)).orderBy("ordinal").collect()
    assert got[0].content == "这些媒体用于存储和传输数据。" and got[0].block_ids == ["b1", "b2"] and (got[0].page_start, got[0].page_end) == (1, 2)
    assert [len(r.content) for r in got] == [14, 120, 61, 62]
    r = chunking.report(chunking.drafts(b, ChunkingConfig(100, 0)), b).first()
    assert (r.cross_page_joins, r.split_units, r.oversized_atomic_units, r.output_chunk_count) == (1, 1, 1, 4)
    assert {x.chunk_id for x in got} == {x.chunk_id for x in chunking.chunks(b.withColumn("ordinal", F.col("ordinal") + 5), ChunkingConfig(100, 0)).collect()}


def test_blocks_without_a_heading_path_are_packed(spark):
    h = ["章"]
    rows = [("甲。", "paragraph", 1, h), ("乙。", "paragraph", 1, None), ("丙。", "code", 1, []), ("丁。", "section_heading", 1, None), ("戊。", "paragraph", 1, None), (None, "paragraph", 1, None), (None, "section_heading", 1, None), ("己。", "paragraph", 1, None)]
    b = blocks(spark, *rows)
    got = chunking.chunks(b).orderBy("ordinal").collect()
    assert [(r.heading_path, r.block_ids) for r in got] == [(h, ["b0"]), ([], ["b1", "b2"]), ([], ["b4"]), ([], ["b7"])] and all(r.chunk_id for r in got)
    drafted = chunking.drafts(b)
    assert {r.kind: r.n for r in chunking.bounds(b, drafted).collect()} == {"long": 0, "lost": 0}
    assert {r.kind: r.n for r in chunking.bounds(b, drafted.where("size(heading_path) > 0")).collect()} == {"long": 0, "lost": 4}


def test_skipped_label_breaks_a_continuation(spark):
    h = ["a"]
    b = blocks(spark, ("offen", "paragraph", 1, h), ("R1", "figure_label", 1, h), ("weiter.", "paragraph", 2, h))
    assert sequences.content_units(sequences.body_groups(b)).count() == 2


def test_orphan_punctuation(spark):
    b = blocks(spark, ("正文没有句号", "paragraph", 1, ["h"]), ("。", "paragraph", 1, ["h"]), ("；", "paragraph", 1, ["h"]))
    out = sequences.orphan_punctuation(b).orderBy("ordinal").collect()
    assert [r.text for r in out] == ["正文没有句号。", "。", "；"]
    assert [r.block_type for r in out] == ["paragraph", "figure_label", "figure_label"]
    assert (sum(r.merged for r in out), sum(r.relabelled for r in out)) == (1, 1)


def test_asof_is_strict(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "j", 9)], "id int, key string, t int")
    right = spark.createDataFrame([("k", 5, "same"), ("k", 4, "before"), ("k", 1, "first")], "key string, t int, v string")
    out = {r.id: r.last_v for r in sequences.asof_before(left, right, "key", "t", "v").collect()}
    assert out == {1: "before", 2: None, 3: None}


def test_boxes_against_brute_force(spark):
    a = [(i, float(i * 37 % 300), float(i * 91 % 300), float(i * 37 % 300 + 20 + i % 90), float(i * 91 % 300 + 15)) for i in range(40)]
    b = [(i, float(i * 53 % 300), float(i * 29 % 300), float(i * 53 % 300 + 30), float(i * 29 % 300 + 70)) for i in range(30)]
    kind = "id long, x0 double, y0 double, x1 double, y1 double"
    got = {tuple(r) for r in sequences.boxes_meet(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect()}
    assert got == {(p[0], q[0]) for p in a for q in b if p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4]}


def test_audit_summary_counts_word_spacing(spark, monkeypatch):
    from quillmesh.plans import block_queries

    b = blocks(spark, ("see www. example for it", "paragraph", 1, ["h"]), ("", "paragraph", 1, ["h"]))
    monkeypatch.setattr(block_queries, "blocks_of", lambda spark, d: b)
    assert {r.severity: r.n for r in block_queries.audit_summary_all(spark, "").collect()} == {"error": 1, "warning": 1}


def test_audit(spark):
    rows = [("1. Overview", "paragraph"), (" ", "paragraph"), ("。", "paragraph"), ("x", "paragraph"), ("www. site", "paragraph"), ("Rx", "paragraph"), ("Ry", "paragraph"), ("Fig", "figure_caption"), ("offen", "paragraph"), (",", "paragraph")]
    b = blocks(spark, *[(t, k, 1, ["h"]) for t, k in rows])
    codes = sorted(r.issue_code for r in audit.block_issues(b).collect())
    assert codes == sorted(["HEADING_LIKE_PARAGRAPH", "EMPTY_BLOCK", "ORPHAN_PUNCTUATION_BLOCK", "ORPHAN_PUNCTUATION_BLOCK", "VERY_SHORT_TEXT_BLOCK", "SUSPICIOUS_WORD_SPACING", "SUSPICIOUS_WORD_SPACING", "POSSIBLE_FIGURE_LABEL_SEQUENCE", "POSSIBLE_READING_ORDER_BREAK", "POSSIBLE_READING_ORDER_BREAK"])
    bad = b.withColumn("page_end", F.lit(0))
    assert bad.count() - 1 == audit.block_issues(bad).where("issue_code = 'INVALID_PAGE_RANGE'").count()
    assert audit.count_mismatch(b, 10, "normalization", "blocks").count() == 0 and audit.count_mismatch(b, 9, "normalization", "blocks").count() == 1
    files = spark.createDataFrame([("images/a.png",)], "path string")
    paths = [("images/a.png", 0), ("/images/a.png", 1), ("images/../a.png", 1), ("images/b.png", 1)]
    for p, n in paths:
        assert audit.missing_images(b.limit(1).withColumn("image_path", F.lit(p)), files).count() == n
    report = spark.createDataFrame([("d", 0.05, 4, 2)], "document_id string, short_fragment_ratio double, source_pages long, pages_requiring_review long")
    assert audit.ratios(report).count() == 2
    lines = spark.createDataFrame([("d", 1, "<!-- formula-not-decoded -->"), ("d", 2, "formula-not-decoded"), ("d", 3, "x")], "document_id string, line_no int, line string")
    fixed = spark.createDataFrame([("d", 1, 7)], "document_id string, line_no int, page long")
    assert sorted((r.issue_code, r.severity) for r in audit.marker_issues(lines, fixed).collect()) == [("FORMULA_NOT_DECODED", "error"), ("FORMULA_NOT_DECODED", "warning"), ("FORMULA_RESTORED_BY_CORRECTION", "warning"), ("TEXT_EXPECTS_MISSING_FORMULA", "warning"), ("TEXT_EXPECTS_MISSING_FORMULA", "warning")]


def layout_document():
    def item(i, label, text, page, top, parent="#/body", layer="body"):
        return {"self_ref": f"#/texts/{i}", "parent": {"$ref": parent}, "content_layer": layer, "label": label, "text": text, "prov": [{"page_no": page, "bbox": {"l": 1.0, "t": 700.0 - top, "r": 9.0, "b": 0.0, "coord_origin": "BOTTOMLEFT"}}]}

    texts = [
        item(0, "page_header", "第 1 章", 1, 1, layer="furniture"), item(1, "section_header", "网络", 1, 20), item(2, "text", "第二段 。", 1, 60), item(3, "text", "第一段。", 1, 40), item(4, "section_header", "1.1 组成", 1, 80),
        item(5, "section_header", "误判", 2, 10), item(6, "text", "in picture", 2, 20, "#/pictures/0"), item(7, "caption", "图 1", 2, 30, "#/pictures/0"), item(8, "page_header", "第1章", 2, 1, layer="furniture"), item(9, "list_item", "一项", 2, 40),
    ]
    pages = {str(p): {"page_no": p, "size": {"width": 500.0, "height": 700.0}} for p in (1, 2)}
    return {"pages": pages, "texts": texts, "pictures": [{"image": {"uri": "/x/assets/a.png"}, "captions": [{"$ref": "#/texts/7"}]}]}


def test_layout(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(layout_document()))
    docs = jsonl.json_object(spark, str(tmp_path / "d.json"), schema.LAYOUT).withColumn("document_id", F.lit("d")).withColumn("source_path", F.lit("d.json"))
    out = layout.normalized(docs).orderBy("ordinal").collect()
    assert [(r.text, r.block_type, r.heading_path) for r in out] == [
        ("第1章 网络", "document_title", ["第1章 网络"]), ("第一段。", "paragraph", ["第1章 网络"]), ("第二段。", "paragraph", ["第1章 网络"]), ("1.1 组成", "section_heading", ["第1章 网络", "1.1 组成"]),
        ("误判", "paragraph", ["第1章 网络", "1.1 组成"]), ("图 1", "figure_caption", ["第1章 网络", "1.1 组成"]), ("一项", "list_item", ["第1章 网络", "1.1 组成"]),
    ]
    assert out[5].image_path == "assets/a.png"
    r = layout.report(docs, layout.normalized(docs)).first()
    assert (r.raw_item_count, r.furniture_count, r.downgraded_count, r.review_pages) == (10, 2, 1, [2]) and r.reordered_count > 0


def test_overlay(spark):
    b = blocks(spark, *[(t, "paragraph", 1, ["h"]) for t in ("eins", "zwei zwei", "drei", "vier", "fuenf")]).withColumn("source_ref", F.concat(F.lit("r"), "ordinal"))

    def c(op, refs, before, after, **k):
        return overlay.Correction(f"c{op}", 1, op, refs, before, after, "why", **k)

    steps = [c("merge_text", ("r2", "r3"), "eins", "vier", replacement="zwei drei"), c("insert_equation", ("r4",), "vier", "fuenf", replacement="x = 1"), c("exclude_from_index", ("r4",), "zwei", "x = 1")]
    out = overlay.applied(b, {"d": steps}).orderBy("ordinal").collect()
    assert [(r.text, r.block_type) for r in out] == [("eins", "paragraph"), ("zwei drei", "paragraph"), ("vier", "figure_label"), ("x = 1", "equation"), ("fuenf", "paragraph")]
    wrong = c("replace_text", ("r2",), "eins", "drei", find_text="zwei", replacement="2")
    with pytest.raises(Exception, match="exactly once"):
        overlay.applied(b, {"d": [wrong]}).collect()
    heading = overlay.applied(b, {"d": [c("reclassify_block", ("r2",), "eins", "drei", block_type="section_heading")]}).orderBy("ordinal").collect()
    assert heading[4].heading_path == ["h", "zwei zwei"] and heading[0].heading_path == ["h"]
    swapped = overlay.applied(b, {"d": [c("reorder_blocks", ("r3", "r2"), "eins", "vier")]}).orderBy("ordinal").collect()
    assert [r.text for r in swapped][1:3] == ["drei", "zwei zwei"]
    assert overlay.counts({"d": steps}) == {"exclude_from_index": 1, "insert_equation": 1, "merge_text": 1}
    doc, read = overlay.read(json.dumps({"document_id": "d", "corrections": [{"id": "a", "page": 1, "operation": "exclude_from_index", "source_refs": ["r1"], "before_text": "x", "after_text": "y", "reason": "z"}]}))
    assert doc == "d" and read[0].source_refs == ("r1",)


def test_formulas(spark):
    pos = "section_id string, page long, top double, left double, original_index long"
    cand = spark.createDataFrame([("s", 1, 1.0, 0.0, 0, "r0", "a"), ("s", 1, 9.0, 0.0, 1, "r1", "b")], pos + ", source_ref string, text string")
    mark = spark.createDataFrame([("s", 1, 5.0, 0.0, 7, "m")], pos + ", marker_ref string")
    r = formulas.anchored(mark, cand).first()
    assert (r.anchor_ref, r.before_text, r.after_text) == ("r0", "a", "b")
    lines = spark.createDataFrame([("s", 4)], "section_id string, line_no int")
    assert formulas.zipped(mark, lines).first().line_no == 4
    with pytest.raises(Exception, match="differ"):
        formulas.zipped(mark, lines.union(lines)).collect()
    rep = spark.createDataFrame([("s", 1, "m", "x=1")], "section_id string, page long, marker_ref string, replacement string")
    ev = formulas.anchored(mark, cand)
    assert formulas.unmatched(rep, ev).count() == 0 and formulas.overlays(rep, ev).first().corrections[0].replacement == "x=1"


def test_corpus(spark):
    chunks = spark.createDataFrame([("a", "d", 5, 5, 9), ("b", "d", 1, 1, 7), ("c", "d", 8, 8, 1)], "chunk_id string, document_id string, page_start long, page_end long, ordinal long")
    sections = spark.createDataFrame([("d", "s1", 1, 3, True), ("d", "s2", 4, 6, True), ("d", "s3", 7, 9, False)], "book_id string, section_id string, start_page long, end_page long, include_in_index boolean")
    assert [(r.chunk_id, r.ordinal) for r in corpus.assembled(chunks, sections).orderBy("ordinal").collect()] == [("b", 1), ("a", 2)]
    assert corpus.overlapping(sections).count() == 0
    assert corpus.selected(sections, ["s2"]).count() == 1
    with pytest.raises(Exception, match="unknown section"):
        corpus.selected(sections, ["nope"]).collect()


def test_strict_scan(spark, tmp_path):
    row = {"case_id": "1", "query": "q", "relevant_chunk_ids": ["a"]}
    good = tmp_path / "good.jsonl"
    good.write_text(json.dumps(row) + "\n")
    assert jsonl.cases(spark, str(good)).first().query == "q"
    for name, line in {"blank": "", "json": "{", "unknown": json.dumps(row | {"x": 1}), "missing": json.dumps({"case_id": "1"}), "type": json.dumps(row | {"query": None})}.items():
        p = tmp_path / f"{name}.jsonl"
        p.write_text(json.dumps(row) + "\n" + line + "\n")
        bad = jsonl.violations(spark, str(p), schema.CASE).collect()
        assert [r.line_no for r in bad] == [2], name
        with pytest.raises(Exception, match="line 2"):
            jsonl.cases(spark, str(p)).collect()
    loose = tmp_path / "loose.jsonl"
    loose.write_text('{"a": true}\n\n{"a": 3}\n')
    assert [r[0] for r in jsonl.lenient(spark, str(loose)).select(jsonl.integer_field("value", "a")).collect()] == [None, 3]


def test_contracts(spark):
    b = blocks(spark, ("ok", "paragraph", 1, ["h"]), ("Kopf", "section_heading", 1, ["anders"]), (" ", "other", 0, ["h"]))
    out = {r.block_id: r.violations for r in schema.block_violations(b).collect()}
    assert out == {"b1": ["heading"], "b2": ["blank", "type", "pages"]}


def test_sinks(spark, tmp_path):
    b = blocks(spark, ("Kopf", "section_heading", 1, ["Kopf"]), ("Text", "list_item", 1, ["Kopf"]))
    sinks.jsonl(b, str(tmp_path / "out"), "ordinal", single=True)
    assert jsonl.blocks(spark, str(tmp_path / "out") + "/part-*").count() == 2
    with pytest.raises(Exception, match="exist"):
        sinks.jsonl(b, str(tmp_path / "out"))
    sinks.markdown(b, sinks.block_markdown(), str(tmp_path / "md"), "ordinal")
    assert "# Kopf" in next((tmp_path / "md").glob("part-*")).read_text()
    chunk = F.struct(F.lit("c").alias("chunk_id"), F.lit("d").alias("document_id"), F.array(F.lit("h")).alias("heading_path"))
    rec = spark.range(1).select(chunk.alias("chunk"), F.struct(F.array(F.lit(1.0), F.lit(0.0)).alias("values"), F.lit(2).cast("bigint").alias("dimensions")).alias("vector"), F.lit("v").alias("embedding_version"))
    t = sinks.VectorTable(spark, str(tmp_path / "vectors"), 2)
    assert t.upsert(rec) == 1 and t.upsert(rec) == 1 and t.count() == 1
    with pytest.raises(ValueError):
        sinks.VectorTable(spark, str(tmp_path / "v3"), 3).upsert(rec)


def test_stream(spark, tmp_path):
    rows = spark.sql("select 'a' as chunk_id, 'd' as document_id, timestamp '2025-01-01 00:00:00' as ingested_at union all select 'a', 'd', timestamp '2025-01-01 00:10:00'")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = ingest.first_seen(ingest.arriving(spark, str(tmp_path / "in"), rows.schema))
    ingest.upserting(stream, lambda df, _: seen.extend(r.chunk_id for r in df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert seen == ["a"]
