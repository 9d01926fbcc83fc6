import math
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.functions.filters import SearchFilters
from quillmesh.operators import dense, evaluation, fusion, lexical
from quillmesh.plans.retrievers import Retrievers, SearchTool, hits_with_chunks

CHUNK = "chunk_id string, document_id string, content string, index_text string, heading_path array<string>, page_start long, page_end long, ordinal long, source_path string"


def corpus(spark, texts, heads=None):
    rows = [(f"c{i}", "d", t, t, (heads or [["h"]] * len(texts))[i], i + 1, i + 1, i + 1, "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CHUNK)


def ask(spark, *queries):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "query_id string, query string")


def test_zero_score_is_a_hit(spark):
    hits = lexical.search(lexical.build(corpus(spark, ["TCP", "HTTP"])), ask(spark, "TCP")).collect()
    assert [(r.chunk_id, r.score, r.rank) for r in hits] == [("c0", 0.0, 1)]


def test_negative_scores_stay_in_order(spark):
    hits = lexical.search(lexical.build(corpus(spark, ["网络", "网络"])), ask(spark, "网络")).orderBy("rank").collect()
    assert [r.chunk_id for r in hits] == ["c0", "c1"] and all(r.score < 0 for r in hits)


def test_score_formula_and_query_repeats(spark):
    chunks = corpus(spark, ["a b b", "a c", "d"])
    hits = {r.chunk_id: r.score for r in lexical.search(lexical.build(chunks), ask(spark, "b b")).collect()}
    idf = math.log(3 - 1 + 0.5) - math.log(1.5)
    want = 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2))
    assert hits == {"c0": pytest.approx(want)}


def test_filters_keep_corpus_statistics(spark):
    index = lexical.build(corpus(spark, ["a x", "a y", "b"]))
    every = {r.chunk_id: r.score for r in lexical.search(index, ask(spark, "a")).collect()}
    some = lexical.search(index, ask(spark, "a"), filters=SearchFilters(page_start=2)).collect()
    assert [(r.chunk_id, r.score) for r in some] == [("c1", every["c1"])]


def test_empty_corpus_and_null_queries(spark):
    index = lexical.build(spark.createDataFrame([], CHUNK))
    assert lexical.search(index, ask(spark, "a", None, "")).count() == 0


def test_candidate_counts(spark):
    chunks = corpus(spark, ["a", "b", "c"], [["x"], ["x", "y"], ["z"]])
    filters = "document_ids array<string>, heading_prefix array<string>, page_start bigint, page_end bigint"
    rows = [("n", None), ("d", (["d", "e"], None, 2, None)), ("h", (None, ["x"], None, None)), ("p", (None, None, None, 2)), ("o", (["q"], None, None, None))]
    queries = spark.createDataFrame(rows, f"query_id string, filters struct<{','.join(f'{a}:{b}' for a, b in (x.split() for x in filters.split(', ')))}>")
    assert {r.query_id: r.candidate_count for r in lexical.candidate_counts(chunks, queries).collect()} == {"n": 3, "d": 2, "h": 2, "p": 2, "o": 0}


def test_dense_blocks_agree(spark):
    rows = [(f"v{i:02d}", "s", [math.cos(i), math.sin(i), (i % 5) / 3]) for i in range(40)]
    v = spark.createDataFrame(rows, "chunk_id string, space string, values array<double>")
    q = v.limit(7).withColumnRenamed("chunk_id", "query_id")
    whole = dense.search(v, q, 4).orderBy("query_id", "rank").collect()
    parts = dense.search(v, q, 4, block=6).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in whole] == [(r.query_id, r.chunk_id) for r in parts]
    assert all(r.query_id == r.chunk_id for r in whole if r.rank == 1)


def test_cosine_and_validity(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(dense.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1)
    rows = [([1.0, 0.0], 2), ([1.0], 2), ([0.0, 0.0], 2), ([float("nan"), 1.0], 2), ([float("inf"), 1.0], 2), (None, 2), ([None, 1.0], 2)]
    ok = spark.createDataFrame(rows, "v array<double>, d long").select(dense.valid_vector(F.col("v"), F.col("d"))).collect()
    assert [r[0] for r in ok] == [True] + [False] * 6


def ranks(spark, name, ids):
    return spark.createDataFrame([("q0", c, i + 1) for i, c in enumerate(ids)], "query_id string, chunk_id string, rank long")


def test_rrf(spark):
    out = fusion.reciprocal_ranks(ranks(spark, "a", "abc"), ranks(spark, "b", "bd")).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.candidate_count) for r in out] == [("b", pytest.approx(1 / 61 + 1 / 62), 4), ("a", pytest.approx(1 / 61), 4), ("d", pytest.approx(1 / 62), 4), ("c", pytest.approx(1 / 63), 4)]


def test_rerank(spark):
    chunks = corpus(spark, ["协议 文本", "协议 文本"], [["网络"], ["协议"]])
    hits = spark.createDataFrame([("q0", "c0", 1.0, 1), ("q0", "c1", 1.0, 2), ("q1", "c0", 0.5, 1), ("q1", "c1", 0.4, 2)], "query_id string, chunk_id string, score double, rank long")
    out = fusion.rerank(hits, ask(spark, "协议", "？？？"), chunks, k=1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in out] == [("q0", "c1"), ("q1", "c0"), ("q1", "c1")]
    with pytest.raises(ValueError):
        fusion.rerank(hits, ask(spark, "a"), chunks, weights=(1, -1, 1))


def test_metrics(spark):
    cases = spark.createDataFrame([("1", ["a", "b"]), ("2", ["z"])], "case_id string, relevant_chunk_ids array<string>")
    hits = spark.createDataFrame([("1", "x", 1), ("1", "a", 2), ("2", "y", 1)], "query_id string, chunk_id string, rank long")
    r = evaluation.report(evaluation.case_results(cases, hits)).first()
    assert (r.case_count, r.hit_rate_at_k, r.mean_recall_at_k, r.mrr) == (2, 0.5, 0.25, 0.25)


def test_case_checks(spark):
    chunks = corpus(spark, ["a", "b"])
    cases = spark.createDataFrame([("1", "q", ["c0", "nope"]), ("2", "q", ["nope"])], "case_id string, query string, relevant_chunk_ids array<string>")
    assert {r.case_id for r in evaluation.unknown_relevant(cases, chunks).collect()} == {"1", "2"}
    assert [(r.case_id, r.relevant_chunk_ids) for r in evaluation.known_only(cases, chunks).collect()] == [("1", ["c0"])]
    assert evaluation.heading_cases(chunks).first().relevant_chunk_ids == ["c0", "c1"]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "point_id string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 2), ("c", 2)], "point_id string, v int")
    once = dense.upsert(old, new)
    assert {(r.point_id, r.v) for r in once.collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert sorted(map(tuple, dense.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_tool(spark):
    chunks = corpus(spark, ["TCP window", "HTTP header"])
    tool = SearchTool(Retrievers(lexical.build(chunks)), ("bm25",))
    out = tool.execute('{"query": "window", "top_k": 3}')
    assert out["success"] and [h["chunk_id"] for h in out["hits"]] == ["c0"]
    for bad in ({"query": " "}, {"query": "a", "top_k": 11}, {"query": "a", "top_k": True}, {"query": "a", "x": 1}, {"query": "a", "retriever": "dense"}, {"query": "a", "page_start": 0}):
        assert not tool.execute(bad)["success"]
    hits = lexical.search(tool.retrievers.index, ask(spark, "window"))
    shown = hits_with_chunks(hits, chunks)
    assert shown.first().pages == "1" and "source_path" not in shown.columns


def test_registry_composes(spark):
    chunks = corpus(spark, ["alpha beta", "beta gamma", "gamma"])
    v = spark.createDataFrame([("c0", "s", [1.0, 0.0]), ("c1", "s", [0.7, 0.7]), ("c2", "s", [0.0, 1.0])], "chunk_id string, space string, values array<double>")
    embed = lambda q: q.select("query_id", F.lit("s").alias("space"), F.array(F.lit(1.0), F.lit(0.0)).alias("values"))
    r = Retrievers(lexical.build(chunks), v, embed)
    assert r.ready()
    top = {n: r.search(n, ask(spark, "alpha"), 1).first().chunk_id for n in ("bm25", "dense", "hybrid", "rerank")}
    assert top == {"bm25": "c0", "dense": "c0", "hybrid": "c0", "rerank": "c0"}
    with pytest.raises(ValueError):
        r.search("other", ask(spark, "a"))


def shuffled(spark):
    """Bytes that the stages of this session wrote to shuffles so far."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_terms_of_chunks_are_shuffled_once_for_many_queries(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(400)) for _ in range(800)]
    chunks = corpus(spark, texts).repartition(4).persist()
    chunks.count()
    queries = ask(spark, *[" ".join(f"w{rng.randrange(3000)}" for _ in range(3)) for _ in range(3000)])
    began = shuffled(spark)
    assert lexical.search(lexical.build(chunks), queries, 3).count() == 9000
    assert shuffled(spark) - began < 3 * sum(map(len, texts))


def test_rerank_searches_once(spark):
    v = spark.createDataFrame([("c0", "s", [1.0, 0.0]), ("c1", "s", [0.7, 0.7])], "chunk_id string, space string, values array<double>")
    embed = lambda q: q.select("query_id", F.lit("s").alias("space"), F.array(F.lit(1.0), F.lit(0.0)).alias("values"))
    hits = Retrievers(lexical.build(corpus(spark, ["alpha", "beta"])), v, embed).search("rerank", ask(spark, "alpha"), 1)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"FlatMapCoGroupsIn{x}") for x in ("Arrow", "Pandas")] == [1, 1]


def test_rerank_with_the_terms_of_an_index(spark):
    chunks = corpus(spark, ["协议 文本", "", "b b c"], [["网络"], ["协议"], ["b"]])
    hits = spark.createDataFrame([("q0", f"c{i}", 1.0, i + 1) for i in range(3)], "query_id string, chunk_id string, score double, rank long")
    known = chunks.select("chunk_id", "heading_path", lexical.joined(lexical.terms_of(F.col("index_text"))).alias("words"))
    by_text, by_terms = ({tuple(r) for r in fusion.rerank(hits, ask(spark, "协议 b"), c, 3).collect()} for c in (chunks, known))
    assert by_text == by_terms and {(r[1], round(r[2], 6)) for r in by_text} == {("c0", 1.666667), ("c1", 1.666667), ("c2", 1.666667)}


def test_dense_tiles_agree(spark, monkeypatch):
    rows = [(f"v{i:02d}", "s", [math.cos(i), math.sin(i), (i % 5) / 3]) for i in range(40)]
    v = spark.createDataFrame(rows, "chunk_id string, space string, values array<double>")
    q = v.withColumnRenamed("chunk_id", "query_id")
    whole = [(r.query_id, r.chunk_id, r.rank) for r in dense.search(v, q, 4).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(dense, "TILE", 130)
    assert [(r.query_id, r.chunk_id, r.rank) for r in dense.search(v, q, 4).orderBy("query_id", "rank").collect()] == whole
