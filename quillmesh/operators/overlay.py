"""Source-anchored corrections of the blocks of a document (T4, T5), applied in order."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import ship

#: The operations of overlays.
OPERATIONS = ("replace_text", "merge_text", "reorder_blocks", "reclassify_block", "exclude_from_index", "insert_equation")


@dataclass(frozen=True)
class Correction:
    id: str
    page: int
    operation: str
    source_refs: tuple[str, ...]
    before_text: str
    after_text: str
    reason: str
    replacement: str | None = None
    find_text: str | None = None
    block_type: str | None = None
    marker_source_ref: str | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.operation not in OPERATIONS:
            raise ValueError(f"unknown operation {self.operation}")
        if isinstance(self.page, bool) or not isinstance(self.page, int) or self.page < 1:
            raise ValueError("page must be a positive integer")
        if not self.source_refs or len(set(self.source_refs)) < len(self.source_refs):
            raise ValueError("source_refs must be given and unique")
        if any(not isinstance(x, str) or not x.strip() for x in (self.id, self.before_text, self.after_text, self.reason)):
            raise ValueError("id, anchors and reason must not be blank")
        needs = {"replace_text": ("find_text", "replacement"), "merge_text": ("replacement",), "reclassify_block": ("block_type",), "insert_equation": ("replacement",)}
        for name in needs.get(self.operation, ()):
            if not getattr(self, name):
                raise ValueError(f"{self.operation} needs {name}")


def read(text: str) -> tuple[str, list[Correction]]:
    """The document id and corrections of an overlay's JSON; ids must be unique."""
    raw = json.loads(text)
    names = {f for f in Correction.__dataclass_fields__ if f != "extra"}
    out = []
    for c in raw["corrections"]:
        known = {k: v for k, v in c.items() if k in names and v is not None}
        out.append(Correction(**(known | {"source_refs": tuple(c["source_refs"]), "extra": {k: v for k, v in c.items() if k not in names}})))
    if len({c.id for c in out}) < len(out):
        raise ValueError("correction ids must be unique")
    return raw["document_id"], out


class Blocks:
    """The rows of one document while corrections change them."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows = rows
        self.original = [dict(r) for r in rows]

    def places(self, c: Correction) -> list[int]:
        at = {r["source_ref"]: i for i, r in enumerate(self.rows)}
        missing = [x for x in c.source_refs if x not in at]
        if missing:
            raise ValueError(f"{c.id}: no block {missing[0]}")
        return [at[x] for x in c.source_refs]

    def anchored(self, c: Correction, rows: list[dict], first: int, last: int) -> None:
        if first < 1 or last + 1 >= len(rows):
            raise ValueError(f"{c.id}: no neighbours to anchor on")
        if c.before_text not in rows[first - 1]["text"] or c.after_text not in rows[last + 1]["text"]:
            raise ValueError(f"{c.id}: the neighbours have other text")

    def apply(self, c: Correction) -> None:
        places = self.places(c)
        if c.operation == "insert_equation":
            at = {r["source_ref"]: i for i, r in enumerate(self.original)}
            i = at[c.source_refs[0]]
            if i + 1 >= len(self.original) or c.before_text not in self.original[i]["text"] or c.after_text not in self.original[i + 1]["text"]:
                raise ValueError(f"{c.id}: the neighbours have other text")
            anchor = self.rows[places[0]]
            new = anchor | {"source_ref": f"overlay:{c.id}", "text": c.replacement, "block_type": "equation", "page_start": c.page, "page_end": c.page, "image_path": None}
            self.rows.insert(places[0] + 1, new)
            return
        if any(self.rows[i]["page_start"] != c.page for i in places):
            raise ValueError(f"{c.id}: a block is on another page")
        self.anchored(c, self.rows, min(places), max(places))
        getattr(self, f"_{c.operation}")(c, places)

    def _replace_text(self, c: Correction, places: list[int]) -> None:
        row = self.rows[places[0]]
        if row["text"].count(c.find_text) != 1:
            raise ValueError(f"{c.id}: the text must occur exactly once")
        row["text"] = row["text"].replace(c.find_text, c.replacement)

    def _merge_text(self, c: Correction, places: list[int]) -> None:
        rows = [self.rows[i] for i in places]
        new = rows[0] | {"source_ref": f"overlay:{c.id}", "text": c.replacement, "page_start": min(r["page_start"] for r in rows), "page_end": max(r["page_end"] for r in rows), "image_path": None}
        if c.block_type:
            new["block_type"] = c.block_type
        self.rows = [new if i == places[0] else r for i, r in enumerate(self.rows) if i == places[0] or i not in places]

    def _reorder_blocks(self, c: Correction, places: list[int]) -> None:
        moved = [self.rows[i] for i in places]
        for slot, row in zip(sorted(places), moved, strict=True):
            self.rows[slot] = row

    def _reclassify_block(self, c: Correction, places: list[int]) -> None:
        i = places[0]
        row, old = self.rows[i], list(self.rows[i]["heading_path"])
        row["block_type"] = c.block_type
        if c.block_type == "section_heading":
            for r in self.rows[i:]:
                path = list(r["heading_path"])
                if path[: len(old)] == old:
                    r["heading_path"] = [*old, row["text"], *path[len(old) :]]

    def _exclude_from_index(self, c: Correction, places: list[int]) -> None:
        for i in places:
            self.rows[i]["block_type"] = "figure_label"


def applied(blocks: DataFrame, overlays: dict[str, list[Correction]]) -> DataFrame:
    """Blocks (with source_ref and ordinal) after the corrections of their document, ordinals counted anew. Only documents with
    an overlay go through a group; the overlays are hand-written and small."""
    ship(blocks.sparkSession)
    columns = blocks.columns

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ordinal")
        b = Blocks([dict(zip(columns, r, strict=True)) for r in f.itertuples(index=False)])
        for c in overlays[f["document_id"].iloc[0]]:
            b.apply(c)
        for i, r in enumerate(b.rows):
            r["ordinal"] = i + 1
        return pd.DataFrame(b.rows, columns=columns)

    named = F.col("document_id").isin(*overlays)
    return blocks.where(~named).unionByName(blocks.where(named).groupBy("document_id").applyInPandas(run, blocks.schema))


def counts(overlays: dict[str, list[Correction]]) -> dict[str, int]:
    """How many corrections of each operation (AGG7)."""
    out: dict[str, int] = {}
    for cs in overlays.values():
        for c in cs:
            out[c.operation] = out.get(c.operation, 0) + 1
    return dict(sorted(out.items()))
