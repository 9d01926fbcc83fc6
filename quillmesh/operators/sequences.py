"""Ordered operators over blocks: reading order, groups, continuations, orphan punctuation, anchors, page joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import ORPHANS, ends_sentence, joined_continuation

#: Roles of block types.
CONTROL = ("document_title", "section_heading")
NOT_INDEXED = ("figure_label",)
ATOMIC = ("table", "code", "equation")
SPLITTABLE = ("paragraph", "list_item", "figure_caption")


def order(by: str = "document_id") -> Window:
    return Window.partitionBy(by).orderBy("ordinal", "block_id")


#: Blocks of a document, by their ordinal, that one task orders.
SPAN = 4096


def stretched(rows: DataFrame, span: int | None = None) -> DataFrame:
    """Rows by ``__stretch``, a range of ordinals of their document, so that a large document is many tasks. Each stretch also has the last row of
    the one before and the first of the one after, as ``__ghost``, for windows that look one row back or ahead (``within``). Only the
    first and last row of each stretch are ordered over the whole document."""
    at = rows.withColumn("__stretch", F.floor(F.coalesce("ordinal", F.lit(0)) / (span or SPAN))).withColumn("__ghost", F.lit(False))
    row, place = F.struct(*[F.col(c) for c in rows.columns]), F.struct("ordinal", "block_id")
    ends = at.groupBy("document_id", "__stretch").agg(F.min_by(row, place).alias("first"), F.max_by(row, place).alias("last"))
    w = Window.partitionBy("document_id").orderBy("__stretch")
    ends = ends.withColumn("__before", F.lag("__stretch").over(w)).withColumn("__after", F.lead("__stretch").over(w))
    ahead = ends.where("__after is not null").select("last.*", F.col("__after").alias("__stretch"), F.lit(True).alias("__ghost"))
    behind = ends.where("__before is not null").select("first.*", F.col("__before").alias("__stretch"), F.lit(True).alias("__ghost"))
    return at.unionByName(ahead).unionByName(behind)


def within() -> Window:
    return Window.partitionBy("document_id", "__stretch").orderBy("ordinal", "block_id")


def own(rows: DataFrame) -> DataFrame:
    """The rows of ``stretched`` without its copies."""
    return rows.where(~F.col("__ghost")).drop("__ghost", "__stretch")


def reading_order(items: DataFrame) -> DataFrame:
    """Rows with their place before and after sorting by (page, top, left, original_index) within a document."""
    before = Window.partitionBy("document_id").orderBy("original_index")
    after = Window.partitionBy("document_id").orderBy("page", "top", "left", "original_index")
    return items.withColumn("place_before", F.row_number().over(before)).withColumn("place_after", F.row_number().over(after))


def moved(items: DataFrame) -> DataFrame:
    """(document_id, moved): rows whose place changed."""
    return reading_order(items).groupBy("document_id").agg(F.count_if(F.col("place_before") != F.col("place_after")).alias("moved"))


def body_groups(blocks: DataFrame) -> DataFrame:
    """Body rows with ``group_no`` (W4): a group ends at a heading or where the heading path changes; labels are left out
    and don't end one."""
    rows = stretched(blocks.where(~F.col("block_type").isin(*NOT_INDEXED)))
    control = F.col("block_type").isin(*CONTROL)
    w = within()
    breaks = control | F.lag(control, 1, True).over(w) | ~F.col("heading_path").eqNullSafe(F.lag("heading_path").over(w))
    marked = rows.withColumn("__b", F.when(breaks, 1).otherwise(0)).where(~F.col("__ghost"))
    before = Window.partitionBy("document_id").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy("document_id", "__stretch").agg(F.sum("__b").alias("__n")).withColumn("__n", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    at = marked.withColumn("group_no", F.sum("__b").over(w)).where(~control).join(sums, ["document_id", "__stretch"])
    return at.withColumn("group_no", F.col("group_no") + F.col("__n")).drop("__b", "__n", "__ghost", "__stretch")


def continues(w: Window) -> Column:
    """Whether a row goes on with the paragraph of the row before on the page before."""

    def before(c: Column | str) -> Column:
        return F.lag(c).over(w)

    test = (before("block_type") == "paragraph") & (F.col("block_type") == "paragraph") & before("heading_path").eqNullSafe(F.col("heading_path"))
    test &= (F.col("ordinal") == before("ordinal") + 1) & (F.col("page_start") == before("page_end") + 1) & ~before(ends_sentence(F.col("text")))
    return F.coalesce(test, F.lit(False))


def content_units(grouped: DataFrame) -> DataFrame:
    """Units of a group: paragraphs joined over pages, with their block ids, pages and the number of joins."""
    w = Window.partitionBy("document_id", "group_no").orderBy("ordinal", "block_id")
    rows = grouped.withColumn("__c", continues(w)).withColumn("unit_no", F.sum((~F.col("__c")).cast("int")).over(w))
    parts = F.sort_array(F.collect_list(F.struct("ordinal", "block_id", "text")))
    units = rows.groupBy("document_id", "group_no", "unit_no").agg(parts.alias("p"), F.first("heading_path").alias("heading_path"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.min_by("block_type", "ordinal").alias("block_type"))
    nothing = F.lit(None).cast("string")
    text = F.aggregate("p", nothing, lambda a, x: F.when(a.isNull(), x["text"]).otherwise(joined_continuation(a, x["text"])))
    return units.select("document_id", "group_no", "unit_no", "heading_path", "block_type", "page_start", "page_end", text.alias("text"), F.transform("p", lambda x: x["block_id"]).alias("block_ids"), (F.size("p") - 1).alias("joins"))


def orphan_punctuation(rows: DataFrame) -> DataFrame:
    """Lone punctuation appended to the body row before it (W6): columns text, block_type (figure_label for every orphan),
    merged and relabelled (0 or 1). The first row of a document is exempt."""
    w = order()
    body = F.col("block_type").isin("paragraph", "list_item")
    orphan = F.coalesce(F.lag(F.lit(1)).over(w).isNotNull() & body & F.col("text").isin(*ORPHANS), F.lit(False))
    rows = rows.withColumn("__o", orphan)
    no_image = F.col("image_path").isNull()
    ends = F.substring(F.col("text"), -1, 1).isin(*ORPHANS)
    fits = F.col("__o") & ~F.lag("__o").over(w) & F.lag(body).over(w) & no_image & F.lag(no_image).over(w) & ~F.lag(ends).over(w)
    fits &= (F.lag("page_start").over(w) == F.col("page_start")) & (F.lag("page_end").over(w) == F.col("page_end"))
    rows = rows.withColumn("__m", F.coalesce(fits, F.lit(False)))
    gets = F.coalesce(F.lead("__m").over(w), F.lit(False))
    rows = rows.withColumn("__t", F.when(gets, F.concat("text", F.lead("text").over(w))).otherwise(F.col("text")))
    kind = F.when(F.col("__o"), "figure_label").otherwise(F.col("block_type"))
    return rows.withColumns({"text": F.col("__t"), "block_type": kind, "merged": F.col("__m").cast("int"), "relabelled": (F.col("__o") & ~F.col("__m")).cast("int")}).drop("__o", "__m", "__t")


def anchors(rows: DataFrame) -> DataFrame:
    """Rows with the text before and after."""
    w = within()
    return own(stretched(rows).withColumn("before_text", F.lag("text").over(w)).withColumn("after_text", F.lead("text").over(w)))


def asof_before(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with ``value`` of the last right row of its key strictly before ``at`` (J8): one window over both
    sides instead of a range join. Equal times are no match; right rows at one time count by their value."""
    l = left.withColumn("__side", F.lit(0)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType))
    r = right.select(key, at, F.lit(1).alias("__side"), F.col(value).alias("__v"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "__side", "__v").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(f"last_{value}", F.last("__v", ignorenulls=True).over(w)).where("__side = 0").drop("__side", "__v")


def boxes_meet(a: DataFrame, b: DataFrame, tile: float = 64.0) -> DataFrame:
    """Pairs (id_a, id_b) of boxes (id, x0, y0, x1, y1) that overlap (J9). Both sides are laid on tiles and joined by tile, so no
    row meets all others; a pair is kept in the tile of its common corner only."""

    def tiled(df: DataFrame, s: str) -> DataFrame:
        xs = F.sequence(F.floor(F.col("x0") / tile), F.floor(F.col("x1") / tile))
        ys = F.sequence(F.floor(F.col("y0") / tile), F.floor(F.col("y1") / tile))
        out = df.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "x0", "y0", "x1", "y1")], F.explode(xs).alias("tx"), ys.alias("ys"))
        return out.withColumn("ty", F.explode("ys")).drop("ys")

    j = tiled(a, "a").join(tiled(b, "b"), ["tx", "ty"]).where("x0_a < x1_b and x0_b < x1_a and y0_a < y1_b and y0_b < y1_a")
    corner = (F.floor(F.greatest("x0_a", "x0_b") / tile) == F.col("tx")) & (F.floor(F.greatest("y0_a", "y0_b") / tile) == F.col("ty"))
    return j.where(corner).select("id_a", "id_b")


def pages_meet(chunks: DataFrame, sections: DataFrame, bucket: int = 16) -> DataFrame:
    """(chunk_id, section_id) of chunks whose pages overlap a section of their document (FIL3). Both sides are laid on buckets of pages
    and joined by document and bucket, so that a large document is many keys; a pair is kept in the first bucket that both have."""

    def laid(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
        low, high = F.floor(F.least(a, b) / bucket), F.floor(F.greatest(a, b) / bucket)
        return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("bucket", F.explode(F.sequence(low, high))).withColumn(name, low)

    c = laid(chunks.select("chunk_id", "document_id", "page_start", "page_end"), "page_start", "page_end", "__c")
    s = laid(sections.select(F.col("book_id").alias("document_id"), "section_id", "start_page", "end_page"), "start_page", "end_page", "__s")
    met = c.join(s, ["document_id", "bucket"]).where("page_start <= end_page and page_end >= start_page")
    return met.where(F.col("bucket") == F.greatest("__c", "__s")).select("chunk_id", "section_id")


def page_coverage(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(book_id, expected, covered, coverage): pages of a book's sections that its chunks stand on (AGG6, AGG16)."""
    want = sections.select("book_id", F.explode(F.sequence("start_page", "end_page")).alias("page")).distinct()
    have = chunks.select(F.col("document_id").alias("book_id"), F.explode(F.sequence("page_start", "page_end")).alias("page")).distinct().withColumn("on", F.lit(1))
    by = want.join(have, ["book_id", "page"], "left").groupBy("book_id").agg(F.count("*").alias("expected"), F.count("on").alias("covered"))
    return by.withColumn("coverage", F.col("covered") / F.col("expected"))


def unequal_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has (J10, SET6)."""
    left, right = a.select(F.col(key)).distinct().withColumn("l", F.lit(1)), b.select(F.col(key)).distinct().withColumn("r", F.lit(1))
    j = left.join(right, key, "full_outer")
    return j.where("l is null or r is null").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that stand in several rows (AGG12)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
