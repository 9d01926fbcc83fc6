"""Layout documents to ordered blocks: extraction, furniture, captions, heading fold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import ids
from quillmesh.functions.text import NUMBERED_HEADING, chapter_marker, heading_level, normalize_text
from quillmesh.operators import overlay
from quillmesh.operators.sequences import orphan_punctuation
from quillmesh.session import ship

#: Layout labels with a block type of their own; all others are paragraphs.
LABELS = {"caption": "figure_caption", "list_item": "list_item", "table": "table", "code": "code", "formula": "equation"}
FURNITURE = ("page_header", "page_footer")


def block_type(label: Column) -> Column:
    pairs = [F.lit(x) for kv in LABELS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[label], F.lit("paragraph"))


def items(documents: DataFrame) -> DataFrame:
    """One row for each text of layout documents (document_id, pages, texts, ...): page range, position from the page's top, and
    whether it is furniture. Several places collapse to the first one on the least page (PRJ9, PRJ10)."""
    rows = documents.select("document_id", "pages", F.posexplode("texts").alias("original_index", "t")).select("document_id", "pages", "original_index", "t.*")
    page = F.array_min(F.transform("prov", lambda p: p["page_no"]))
    at = rows.withColumn("page_start", page).withColumn("page_end", F.array_max(F.transform("prov", lambda p: p["page_no"])))
    first = F.filter("prov", lambda p: p["page_no"] == F.col("page_start"))[0]["bbox"]
    at = at.withColumn("box", first)
    height = F.try_element_at("pages", F.col("page_start").cast("string"))["size"]["height"]
    top = F.when(F.col("box.coord_origin") == "BOTTOMLEFT", height - F.col("box.t")).when(F.col("box.coord_origin") == "TOPLEFT", F.col("box.t")).otherwise(F.raise_error(F.lit("unknown coordinate origin")))
    furniture = F.col("label").isin(*FURNITURE) | F.coalesce(F.col("content_layer") == "furniture", F.lit(False))
    return at.select("document_id", "original_index", F.col("self_ref").alias("source_ref"), "label", "text", F.col("parent")["$ref"].alias("parent_ref"), "page_start", "page_end", top.alias("top"), F.col("box.l").alias("left"), furniture.alias("furniture"))


def body_items(rows: DataFrame) -> DataFrame:
    """Text of the body: no furniture, nothing inside pictures but captions, nothing empty (FIL4-FIL6)."""
    inside = F.coalesce(F.col("parent_ref").startswith("#/pictures/"), F.lit(False)) & (F.col("label") != "caption")
    return rows.where(~F.col("furniture") & ~inside).withColumn("text", normalize_text(F.col("text"))).where(F.char_length("text") > 0)


def markers(rows: DataFrame) -> DataFrame:
    """Chapter markers in the furniture, those that repeat the active one left out."""
    found = rows.where("furniture").withColumn("text", chapter_marker(F.col("text"))).where("text is not null")
    w = Window.partitionBy("document_id").orderBy("page_start", "top", "left", "original_index")
    return found.withColumn("__p", F.lag("text").over(w)).where("__p is null or __p != text").drop("__p")


def caption_images(documents: DataFrame) -> DataFrame:
    """(document_id, source_ref, image_path, conflict) of captions."""
    p = documents.select("document_id", F.explode("pictures").alias("p")).select("document_id", F.col("p.image.uri").alias("uri"), F.explode("p.captions").alias("c"))
    by = p.groupBy("document_id", F.col("c")["$ref"].alias("source_ref")).agg(F.min(relative_image(F.col("uri"))).alias("image_path"), F.count_distinct("uri").alias("n"))
    return by.select("document_id", "source_ref", "image_path", (F.col("n") > 1).alias("conflict"))


def relative_image(uri: Column, root: str | None = None) -> Column:
    """A path below the artifact folder (PRJ11): a relative one stays, an absolute one under ``root`` loses it, else it begins at its
    last ``assets`` part. Paths with ``..`` and others are an error."""
    parts = F.split(F.replace(uri, F.lit("\\"), F.lit("/")), "/")
    back = F.array_position(F.reverse(parts), "assets").cast("int")
    tail = F.array_join(F.slice(parts, -back, back), "/")
    absolute = uri.startswith("/") | uri.rlike("^[A-Za-z]:")
    out = F.when(F.array_contains(parts, ".."), F.raise_error(F.lit("image path leaves its folder"))).when(~absolute, F.array_join(parts, "/"))
    if root:
        out = out.when(uri.startswith(root.rstrip("/") + "/"), F.substring(uri, len(root.rstrip("/")) + 2, 100_000))
    return out.when(back > 0, tail).otherwise(F.raise_error(F.lit("image path is outside the artifacts")))


def heading_fold(rows: DataFrame) -> DataFrame:
    """Items and markers of documents in reading order with block types and heading paths.

    A marker opens a segment. A segment's first header without number is its title; what stands before the title of a segment
    that a marker opened is dropped; later ones are paragraphs and counted as downgraded. Numbered headers cut the stack of
    headings to their level. The fold is sequential within a document, so it is one group of its headers only: body rows take
    the path of the header before them by a window."""
    ship(rows.sparkSession)
    body = body_items(rows).withColumn("kind", F.lit(1))
    marks = markers(rows).withColumn("kind", F.lit(0))
    both = body.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("document_id").orderBy("page_start", "top", "left", "original_index", "kind")
    placed = both.withColumn("place", F.row_number().over(w).cast("bigint"))
    header = (F.col("kind") == 1) & (F.col("label") == "section_header")
    number, title = F.regexp_extract("text", NUMBERED_HEADING, 1), F.trim(F.regexp_extract("text", NUMBERED_HEADING, 2))
    placed = placed.withColumn("number", F.when(header, number)).withColumn("title", F.when(header, title)).withColumn("level", F.when(F.col("number") != "", heading_level(F.col("number"))))
    steering = placed.where(header | (F.col("kind") == 0)).select("document_id", "place", "kind", "text", "number", "title", "level")

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        pending: str | None = None
        stack: list[str] = []
        titled = False
        for r in f.sort_values("place").itertuples():
            kind, path, text, dropped, down = None, None, r.text, False, False
            if r.kind == 0:
                pending, stack = r.text, []
            elif not r.number and (pending or not titled):
                text = f"{pending} {r.text}" if pending else r.text
                stack, kind = [text], "section_heading" if titled else "document_title"
                titled, pending = True, None
            elif pending:
                dropped = True
            elif r.number:
                text = f"{r.number} {r.title}"
                stack, kind = [*(stack or ["Document"])[: int(r.level) - 1], text], "section_heading"
            else:
                down, kind = True, "paragraph"
            path = list(stack) or ["Document"]
            out.append((r.document_id, r.place, kind, text, path, pending is not None, dropped, down))
        return pd.DataFrame(out, columns=["document_id", "place", "kind2", "text2", "path", "waiting", "dropped", "downgraded"])

    folded = steering.groupBy("document_id").applyInPandas(fold, "document_id string, place bigint, kind2 string, text2 string, path array<string>, waiting boolean, dropped boolean, downgraded boolean")
    at = placed.join(folded, ["document_id", "place"], "left")
    before = Window.partitionBy("document_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("path").isNotNull(), F.struct("path", "waiting"))
    at = at.withColumn("__s", F.last(own, ignorenulls=True).over(before))
    kept = at.where((F.col("kind") == 1) & ~F.coalesce("dropped", F.lit(False)) & ~(F.col("path").isNull() & F.coalesce(F.col("__s.waiting"), F.lit(False))))
    return kept.select(
        "document_id", "source_ref", F.coalesce("text2", "text").alias("text"), F.coalesce("kind2", block_type(F.col("label"))).alias("block_type"),
        F.coalesce(F.col("__s.path"), F.array(F.lit("Document"))).alias("heading_path"), "page_start", "page_end", "place", F.coalesce("downgraded", F.lit(False)).alias("downgraded"),
    )


def normalized(documents: DataFrame, version: str = "1.1.0", overlays: dict[str, list[overlay.Correction]] | None = None) -> DataFrame:
    """Normalized blocks of layout documents (document_id, source_path, pages, texts, pictures): extraction, heading fold, the corrections of
    ``overlays`` by document, lone punctuation, ids (T1). With a column ``identity``, that is the document's id in the hashes, while document_id
    only tells layouts apart. A caption of several pictures and a block on a page the document doesn't have are errors when the rows are read (J4, T6)."""
    rows = items(documents)
    image = F.when(F.col("conflict"), F.raise_error(F.concat(F.lit("a caption belongs to several pictures: "), "source_ref"))).otherwise(F.col("image_path"))
    images = caption_images(documents).select("document_id", "source_ref", image.alias("image_path"))
    folded = heading_fold(rows).join(images, ["document_id", "source_ref"], "left").withColumn("ordinal", F.col("place")).withColumn("block_id", F.col("source_ref"))
    if overlays:
        folded = overlay.applied(folded.drop("place"), overlays).withColumn("place", F.col("ordinal"))
    merged = orphan_punctuation(folded)
    w = Window.partitionBy("document_id").orderBy("place")
    identity = F.col("identity") if "identity" in documents.columns else F.col("document_id")
    facts = documents.select("document_id", identity.alias("identity"), "source_path", F.transform(F.map_values("pages"), lambda p: p["page_no"]).alias("__pages"))
    at = merged.withColumn("ordinal", F.row_number().over(w).cast("bigint")).withColumn("version", F.lit(version)).join(facts, "document_id")
    parts = [F.col(p) for p in ("identity", "version", "source_ref", "page_start", "page_end", "block_type")]
    at = at.withColumn("block_id", ids.block_id(*parts, F.array_join("heading_path", "\n"), F.col("text")))
    known = F.array_contains("__pages", F.col("page_start")) & F.array_contains("__pages", F.col("page_end"))
    at = at.withColumn("page_start", F.when(known, F.col("page_start")).otherwise(F.raise_error(F.concat(F.lit("a block is on a page outside the source: "), "source_ref"))))
    extra = ["identity"] if "identity" in documents.columns else []
    return at.select("block_id", "document_id", "text", "block_type", "heading_path", "page_start", "page_end", "ordinal", "source_path", "image_path", F.col("version").alias("normalization_version"), "source_ref", "merged", "relabelled", "downgraded", *extra)


def report(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, counters, review_pages): AGG5 and AGG6. Review pages are those without a block and those with a downgraded header."""
    rows = items(documents)
    order = Window.partitionBy("document_id").orderBy("original_index")
    sorted_ = Window.partitionBy("document_id").orderBy("page_start", "top", "left", "original_index")
    body = body_items(rows).withColumn("a", F.row_number().over(order)).withColumn("b", F.row_number().over(sorted_))
    raw = rows.groupBy("document_id").agg(F.count("*").alias("raw_item_count"), F.count_if("furniture").alias("furniture_count"))
    moved = body.groupBy("document_id").agg(F.count_if(F.col("a") != F.col("b")).alias("reordered_count"))
    counts = blocks.groupBy("document_id").agg(
        F.count("*").alias("normalized_block_count"), F.count_if("downgraded").alias("downgraded_count"), F.sum("merged").alias("orphan_merged_count"), F.sum("relabelled").alias("orphan_non_indexable_count"),
        F.round(F.avg((F.char_length("text") <= 3).cast("double")), 6).alias("short_fragment_ratio"), F.array_distinct(F.flatten(F.collect_set(F.sequence("page_start", "page_end")))).alias("on"), F.collect_set(F.when(F.col("downgraded"), F.col("page_start"))).alias("down"),
    )
    pages = documents.select("document_id", F.transform(F.map_values("pages"), lambda p: p["page_no"]).alias("source_pages"))
    out = raw.join(moved, "document_id", "left").join(counts, "document_id", "left").join(pages, "document_id")
    return out.withColumn("review_pages", F.array_sort(F.array_union(F.array_except("source_pages", "on"), "down"))).drop("on", "down")
