"""Ordered operators over stretches of a document give what one window gives."""

import random

from quillmesh.operators import audit, sequences

BLOCK = "block_id string, document_id string, text string, block_type string, heading_path array<string>, page_start long, page_end long, ordinal long"


def test_stretches_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    kinds = ["paragraph"] * 5 + ["section_heading", "figure_label", "list_item"]
    rows = [(f"b{i}", f"d{i % 3}", rng.choice(["Text.", "Text", "。", ","]), rng.choice(kinds), rng.choice([["a"], ["b"], None]), 1 + i // 9, 1 + i // 9, i * rng.choice([1, 1, 1]) + (40 if i > 50 else 0)) for i in range(90)]
    df = spark.createDataFrame(rows, BLOCK)

    def all_of():
        groups = {(r.block_id, r.group_no) for r in sequences.body_groups(df).collect()}
        anchors = {(r.block_id, r.before_text, r.after_text) for r in sequences.anchors(df).collect()}
        breaks = {r.block_id for r in audit.order_breaks(df).collect()}
        return groups, anchors, breaks

    whole = all_of()
    monkeypatch.setattr(sequences, "SPAN", 7)
    assert all_of() == whole and all(whole)
