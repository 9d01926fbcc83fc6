"""Corpus assembly from sections of books, and checks of the section table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assembled(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks of indexed sections in the order of the sections, with new ordinals for each book and unchanged ids.
    A chunk belongs to the first indexed section that its first page lies in. Sections are laid on buckets of 16 pages, so that
    chunks of a large book meet only the sections near them."""
    s = sections.where("include_in_index and start_page <= end_page").select("book_id", "section_id", "start_page", "end_page")
    s = s.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start_page") / 16), F.floor(F.col("end_page") / 16))))
    at = chunks.withColumn("book_id", F.col("document_id")).withColumn("__bucket", F.floor(F.col("page_start") / 16)).join(s, ["book_id", "__bucket"]).where("page_start between start_page and end_page").drop("__bucket")
    first = Window.partitionBy("chunk_id").orderBy("start_page", "section_id")
    one = at.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    place = Window.partitionBy("book_id").orderBy("start_page", "section_id", "ordinal", "chunk_id")
    return one.withColumn("ordinal", F.row_number().over(place).cast("bigint"))


def overlapping(sections: DataFrame) -> DataFrame:
    """Sections that begin before the one before them in their book ends (manifest rule)."""
    w = Window.partitionBy("book_id").orderBy("start_page", "end_page", "section_id")
    return sections.withColumn("before", F.lag("end_page").over(w)).where("before >= start_page").drop("before")


def section_counts(assembled_chunks: DataFrame, issues: DataFrame) -> DataFrame:
    """(book_id, section_id, chunks, warnings) for the corpus manifest (AGG20)."""
    n = assembled_chunks.groupBy("book_id", "section_id").agg(F.count("*").alias("chunks"))
    w = issues.where("severity = 'warning'").join(assembled_chunks.select("chunk_id", "book_id", "section_id"), "chunk_id").groupBy("book_id", "section_id").agg(F.count("*").alias("warnings"))
    return n.join(w, ["book_id", "section_id"], "left").withColumn("warnings", F.coalesce("warnings", F.lit(0)))


def unequal_sections(results: DataFrame, sections: DataFrame) -> DataFrame:
    """(book_id, section_id) that only one of two section sets has."""
    keys = ["book_id", "section_id"]
    a, b = results.select(*keys).distinct(), sections.select(*keys).distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def selected(sections: DataFrame, wanted: list[str]) -> DataFrame:
    """The sections asked for; an unknown id is an error when the rows are read (FIL11)."""
    ask = sections.sparkSession.createDataFrame([(w,) for w in wanted], "section_id string")
    checked = ask.join(sections.select("section_id", F.lit(True).alias("__k")).distinct(), "section_id", "left")
    known = checked.withColumn("section_id", F.when(F.col("__k"), F.col("section_id")).otherwise(F.raise_error(F.concat(F.lit("unknown section "), "section_id"))))
    return sections.join(known.select("section_id"), "section_id", "left_semi")
