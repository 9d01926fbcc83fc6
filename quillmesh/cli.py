"""Command line over the library: normalize, chunk, embed, index, search, evaluate, audit, tool. Exit 0 done, 1 audit errors, 2 bad input."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.analyzer import Analyzer
from quillmesh.functions.filters import SearchFilters
from quillmesh.operators import audit, chunking, dense, evaluation, fusion, lexical, overlay, sinks
from quillmesh.plans.retrievers import NAMES, Retrievers, SearchTool
from quillmesh.session import local_session
from quillmesh.sources import jsonl, layout
from quillmesh.sources.schema import BLOCK, LAYOUT


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmesh")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *needed: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for n in needed:
            c.add_argument(f"--{n}", required=True)
        return c

    c = command("chunk-normalized", "input", "output")
    c.add_argument("--max-chars", type=int, default=1200)
    c.add_argument("--overlap-chars", type=int, default=120)
    c.add_argument("--chunking-version", default="1.1.0")
    for name in NAMES:
        meaning = () if name == "bm25" else ("collection", "embedder", "dimensions")
        for verb, needed in (("search", ("query",)), ("evaluate", ("cases",))):
            c = command(f"{verb}-{name}", *(() if name == "dense" else ("chunks",)), *needed, *meaning)
            c.add_argument("--top-k", type=int, default=5)
            c.add_argument("--stopword", action="append", default=[])
            c.add_argument("--user-word", action="append", default=[])
            c.add_argument("--words", help="a file of lines 'word count'; text is then segmented by it")
            c.add_argument("--instruction", default="")
            for n, default in (("fetch-k", fusion.FETCH_K), ("rrf-k", fusion.RRF_K), ("leg-k", fusion.LEG_K)):
                c.add_argument(f"--{n}", type=int, default=default)
            if verb == "search":
                c.add_argument("--document-id", action="append")
                c.add_argument("--heading", action="append")
                c.add_argument("--page-start", type=int)
                c.add_argument("--page-end", type=int)
                c.add_argument("--json", action="store_true")
            else:
                c.add_argument("--dataset-id", default="dataset")
    c = command("normalize-layout", "input", "source", "output")
    c.add_argument("--overlay")
    c.add_argument("--version", default="1.1.0")
    c = command("embed-chunks", "chunks", "embedder", "dimensions", "version", "output")
    c.add_argument("--batch", type=int, default=8)
    command("index-vectors", "records", "collection", "dimensions")
    c = command("audit-artifacts", "blocks", "chunks")
    c.add_argument("--output")
    c.add_argument("--markdown", help="the Markdown of the layout, for the rules of undecoded formulas")
    c.add_argument("--reported-blocks", type=int)
    c.add_argument("--reported-chunks", type=int)
    c.add_argument("--max-chars", type=int, default=1200)
    sub.add_parser("search-tool-schema")
    command("execute-search-tool", "chunks", "arguments")
    return p


def loaded(name: str) -> Callable[[list[str]], list[list[float]]]:
    """An embedding function named ``module:function``: texts in, one vector for each out."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def retrievers(spark: SparkSession, a: argparse.Namespace, name: str) -> Retrievers:
    """The retrievers that a command needs: a lexical index of the chunks and a collection of vectors."""
    vectors = embed = None
    if name != "bm25":
        found = sinks.VectorTable(spark, a.collection, int(a.dimensions))
        if found.create():
            raise ValueError("the collection has no vectors")
        stored, function = found.read(), loaded(a.embedder)
        vectors = stored.withColumn("space", F.lit("all"))

        def embed(queries: DataFrame) -> DataFrame:
            rows = queries.select("query_id", "query").collect()  # the questions of one command
            got = function([f"Instruct: {a.instruction}\nQuery: {r.query}" if a.instruction else r.query for r in rows])
            if len(got) != len(rows) or any(len(v) != int(a.dimensions) for v in got):
                raise ValueError("the embedding source gave other numbers of vectors or dimensions")
            return spark.createDataFrame([(r.query_id, "all", [float(x) for x in v]) for r, v in zip(rows, got, strict=True)], "query_id string, space string, values array<double>")

    chunks = dense.restored(vectors) if name == "dense" else jsonl.chunks(spark, a.chunks).drop("file", "line_no")
    analyzer = None
    if a.words or a.user_word:
        pairs = [line.split() for line in open(a.words, encoding="utf-8")] if a.words else []
        analyzer = Analyzer({p[0]: int(p[1]) for p in pairs if len(p) > 1}, a.user_word, a.stopword)
    index = lexical.build(chunks, stopwords=tuple(a.stopword), analyzer=analyzer, check=name != "dense")
    return Retrievers(index, vectors, embed)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "chunk-normalized":
        config = chunking.ChunkingConfig(a.max_chars, a.overlap_chars, a.chunking_version)
        sinks.jsonl(chunking.chunks(jsonl.blocks(spark, a.input), config), a.output, "document_id", "ordinal", single=True)
        return 0
    if a.command == "search-tool-schema":
        print(json.dumps(SearchTool(None, ("bm25",)).schema(), ensure_ascii=False))  # type: ignore[arg-type]
        return 0
    if a.command == "normalize-layout":
        source = jsonl.file_hashes(spark, a.source).first().document_id
        docs = jsonl.json_object(spark, a.input, LAYOUT).withColumn("document_id", F.lit(source)).withColumn("source_path", F.lit(a.source))
        corrections = None
        if a.overlay:
            document, rows = overlay.read(open(a.overlay, encoding="utf-8").read())
            if document != source:
                raise ValueError("the overlay is for another document")
            corrections = {document: rows}
        blocks = layout.normalized(docs, a.version, corrections)
        sinks.jsonl(blocks.select(*[f.name for f in BLOCK.fields]), a.output, "document_id", "ordinal", single=True)
        return 0
    if a.command == "embed-chunks":
        records = sinks.embedded(jsonl.chunks(spark, a.chunks).drop("file", "line_no"), loaded(a.embedder), int(a.dimensions), a.version, a.batch)
        records.write.mode("errorifexists").parquet(a.output)
        return 0
    if a.command == "index-vectors":
        table = sinks.VectorTable(spark, a.collection, int(a.dimensions))
        records = spark.read.parquet(a.records)
        print(json.dumps({"collection": a.collection, "dimensions": int(a.dimensions), "upserted": records.count(), "points": table.upsert(records)}))
        return 0
    if a.command == "audit-artifacts":
        blocks, chunks = jsonl.blocks(spark, a.blocks), jsonl.chunks(spark, a.chunks)
        lines = jsonl.lines_of(spark, a.markdown).select(F.col("file").alias("document_id"), "line_no", "line") if a.markdown else None
        found = audit.full(audit.Artifacts(blocks, chunks, a.reported_blocks, a.reported_chunks, lines=lines), audit.AuditConfig(max_chars=a.max_chars)).persist()
        if a.output:
            sinks.jsonl(found, a.output, "stage_no", "document_id", "issue_no", single=True)
        counts = {r.severity: r.n for r in audit.summary(found).collect()}
        print(json.dumps({"passed": not counts.get("error"), **counts}))
        return 1 if counts.get("error") else 0
    if a.command == "execute-search-tool":
        out = SearchTool(Retrievers(lexical.build(jsonl.chunks(spark, a.chunks).drop("file", "line_no"))), ("bm25",)).execute(a.arguments)
        print(json.dumps(out, ensure_ascii=False))
        return 0 if out["success"] else 2
    verb, _, name = a.command.partition("-")
    r = retrievers(spark, a, name)
    sizes = {"fetch_k": max(a.fetch_k, a.top_k), "rrf_k": a.rrf_k, "leg_k": a.leg_k}
    if verb == "search":
        filters = SearchFilters(tuple(a.document_id) if a.document_id else None, tuple(a.heading) if a.heading else None, a.page_start, a.page_end)
        queries = spark.createDataFrame([("q", a.query)], "query_id string, query string")
        hits = r.search(name, queries, a.top_k, filters, **sizes).join(r.index.chunks, "chunk_id").orderBy("rank")
        rows = hits.select("rank", "score", "chunk_id", "page_start", "page_end", "heading_path", "content", sinks.hits_text().alias("shown")).collect()
        for row in rows:
            print(json.dumps({k: v for k, v in row.asDict().items() if k != "shown"}, ensure_ascii=False) if a.json else row.shown)
        return 0
    cases = jsonl.cases(spark, a.cases)
    if not evaluation.duplicate_cases(cases).isEmpty() or not evaluation.unknown_relevant(cases, r.index.chunks).isEmpty():
        raise ValueError("case ids must be unique and relevant ids known")
    hits = r.search(name, cases.selectExpr("case_id as query_id", "query"), a.top_k, **sizes)
    print(json.dumps({"dataset_id": a.dataset_id, "retriever": name, "top_k": a.top_k, **evaluation.report(evaluation.case_results(cases, hits, a.top_k)).first().asDict()}))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return run(spark or local_session(), a)
    except Exception as e:  # noqa: BLE001
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
