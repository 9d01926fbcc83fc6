"""The command line, end to end over files."""

import json

import pytest

from quillmesh import cli
from quillmesh.functions.embedders import hashed

EMBED = ("--embedder", "quillmesh.functions.embedders:hashed", "--dimensions", "64")


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    rows = []
    for i, text in enumerate(["TCP window of the sender", "HTTP header of the request", "routing table of the node"]):
        rows.append({"chunk_id": f"c{i}", "document_id": "d", "content": text, "index_text": "Book\n\n" + text, "heading_path": ["Book"], "page_start": i + 1, "page_end": i + 1, "ordinal": i + 1, "block_ids": [f"b{i}"], "source_path": "p", "content_hash": "h", "normalization_version": "1", "chunking_version": "1"})
    (root / "chunks.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n", encoding="utf-8")
    cases = [{"case_id": "1", "query": "TCP window", "relevant_chunk_ids": ["c0"]}, {"case_id": "2", "query": "routing table", "relevant_chunk_ids": ["c2"]}]
    (root / "cases.jsonl").write_text("\n".join(map(json.dumps, cases)) + "\n", encoding="utf-8")
    return root


def said(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_embed_index_search_and_evaluate(spark, files, capsys):
    chunks, vectors, table = (str(files / n) for n in ("chunks.jsonl", "vectors", "table"))
    assert cli.main(["embed-chunks", "--chunks", chunks, *EMBED, "--version", "hashed", "--output", vectors], spark) == 0
    assert cli.main(["index-vectors", "--records", vectors, "--collection", table, "--dimensions", "64"], spark) == 0
    assert said(capsys)[-1]["points"] == 3
    assert cli.main(["search-dense", "--collection", table, *EMBED, "--query", "TCP window", "--top-k", "1", "--json"], spark) == 0
    assert said(capsys)[0]["chunk_id"] == "c0"
    assert cli.main(["evaluate-hybrid", "--chunks", chunks, "--collection", table, *EMBED, "--cases", str(files / "cases.jsonl"), "--top-k", "1"], spark) == 0
    assert said(capsys)[-1]["mrr"] == 1.0
    assert cli.main(["search-rerank", "--chunks", chunks, "--collection", table, *EMBED, "--query", "routing", "--top-k", "1", "--json"], spark) == 0
    assert said(capsys)[0]["chunk_id"] == "c2"
    assert cli.main(["search-dense", "--collection", str(files / "none"), *EMBED, "--query", "x"], spark) == 2


def test_lexical_commands(spark, files, capsys):
    chunks = str(files / "chunks.jsonl")
    assert cli.main(["search-bm25", "--chunks", chunks, "--query", "header", "--user-word", "request", "--json"], spark) == 0
    assert said(capsys)[0]["chunk_id"] == "c1"
    assert cli.main(["evaluate-bm25", "--chunks", chunks, "--cases", str(files / "cases.jsonl")], spark) == 0
    assert said(capsys)[-1]["hit_rate_at_k"] == 1.0
    assert cli.main(["search-bm25", "--chunks", chunks, "--query", "x", "--top-k", "0"], spark) == 2


def test_hashed_vectors():
    a, b = hashed(["x y", ""])
    assert sum(v * v for v in a) == pytest.approx(1) and b[0] == 1.0
