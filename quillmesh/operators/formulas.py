"""Formula markers: anchors by position, native text in a box, overlays from reviewed replacements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.sequences import boxes_meet

POSITION = ("page", "top", "left", "original_index")


def anchored(markers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Markers with the last candidate strictly before them in reading order and the text before and after: one window over
    both. Both have section_id, the position columns; candidates also source_ref and text."""
    c = candidates.select("section_id", *POSITION, F.lit(1).alias("side"), "source_ref", "text")
    m = markers.select("section_id", *POSITION, F.lit(0).alias("side"), "marker_ref")
    both = c.unionByName(m, allowMissingColumns=True)
    w = Window.partitionBy("section_id").orderBy(*POSITION, "side")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    at = both.withColumn("anchor_ref", F.last("source_ref", ignorenulls=True).over(back)).withColumn("before_text", F.last("text", ignorenulls=True).over(back)).withColumn("after_text", F.first("text", ignorenulls=True).over(ahead))
    return at.where("side = 0").select("section_id", *POSITION, "marker_ref", "anchor_ref", "before_text", "after_text")


def zipped(objects: DataFrame, lines: DataFrame) -> DataFrame:
    """Formula objects with the Markdown lines of their markers, by order; sections whose numbers differ are an error."""
    w = Window.partitionBy("section_id")
    a = objects.withColumn("n", F.row_number().over(w.orderBy(*POSITION))).withColumn("objects", F.count("*").over(w))
    b = lines.withColumn("n", F.row_number().over(w.orderBy("line_no"))).withColumn("lines", F.count("*").over(w))
    j = a.join(b, ["section_id", "n"], "full_outer")
    wrong = F.coalesce("objects", F.lit(0)) != F.coalesce("lines", F.lit(0))
    return j.withColumn("line_no", F.when(wrong, F.raise_error(F.lit("markers and formulas differ in number"))).otherwise(F.col("line_no"))).drop("n", "objects", "lines")


def native_text(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """(id, text): native text blocks (id, page is part of the id space, box, text) that meet a formula's box, top to bottom."""
    hit = boxes_meet(boxes, words).join(words.select(F.col("id").alias("id_b"), "text", "x0", "y0"), "id_b")
    return hit.groupBy(F.col("id_a").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "text"))), lambda r: r["text"]), " ").alias("text"))


KEY = ("section_id", "page", "marker_ref")


def unmatched(replacements: DataFrame, evidence: DataFrame) -> DataFrame:
    """Keys that only one side has or that a side repeats; none is the condition to build overlays."""
    r = replacements.groupBy(*KEY).agg(F.count("*").alias("r"))
    e = evidence.groupBy(*KEY).agg(F.count("*").alias("e"))
    return r.join(e, list(KEY), "full_outer").where("r is null or e is null or r > 1 or e > 1")


def overlays(replacements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(section_id, corrections) from reviewed replacements and their evidence with equal keys."""
    one = replacements.join(evidence, list(KEY))
    item = F.struct("page", "marker_ref", F.col("anchor_ref").alias("source_ref"), "before_text", "after_text", "replacement")
    return one.groupBy("section_id").agg(F.sort_array(F.collect_list(item)).alias("corrections"))
