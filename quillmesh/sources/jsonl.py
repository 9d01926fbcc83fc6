"""Strict and lenient scans of JSON lines, JSON objects, Markdown lines and file hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.text import is_blank
from quillmesh.sources.schema import BLOCK, CASE, CHUNK


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, line_no from 1. Numbering needs a file's lines in order: a file is read
    whole by one task, so that artifacts of one book stay cheap and many books are many tasks."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r?\n\z", "").alias("value"))
    some = whole.where(F.char_length("value") > 0).select("file", F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    return some.select("file", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")


def parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines with ``row`` and ``error``: blank line, bad JSON, unknown or missing fields. Optional fields may be missing."""
    row = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    keys = F.map_keys(F.from_json("line", "map<string,string>"))
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    needed = F.array(*[F.lit(f.name) for f in schema.fields if not f.nullable])
    values = [F.lit(f.name) for f in schema.fields if not f.nullable]
    null = F.array_compact(F.array(*[F.when(F.col("row")[f.name].isNull(), F.lit(f.name)) for f in schema.fields if not f.nullable])) if values else F.array()
    at = lines.withColumn("row", row).withColumn("__k", keys)
    error = (
        F.when(is_blank(F.col("line")), "blank line")
        .when(F.col("__k").isNull(), "not a JSON object")
        .when(F.size(F.array_except("__k", known)) > 0, F.concat(F.lit("unknown field "), F.array_except("__k", known)[0]))
        .when(F.size(F.array_except(needed, F.col("__k"))) > 0, F.concat(F.lit("missing field "), F.array_except(needed, F.col("__k"))[0]))
        .when(F.size(null) > 0, F.concat(F.lit("bad value of "), null[0]))
    )
    return at.withColumn("error", error).drop("__k")


def strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows in file order; the first bad line is an error with its number when the rows are read."""
    at = parsed(lines_of(spark, path), schema)
    message = F.concat(F.lit("line "), F.col("line_no"), F.lit(": "), F.col("error"))
    checked = at.withColumn("row", F.when(F.col("error").isNull(), F.col("row")).otherwise(F.raise_error(message)))
    return checked.select("file", "line_no", "row.*")


def violations(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line_no, error) of the bad lines, for reports instead of an error."""
    return parsed(lines_of(spark, path), schema).where("error is not null").select("file", "line_no", "error")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return strict(spark, path, CHUNK)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return strict(spark, path, BLOCK)


def cases(spark: SparkSession, path: str) -> DataFrame:
    return strict(spark, path, CASE)


def lenient(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of any JSON lines as VARIANT; blank lines are skipped, bad JSON is null."""
    some = lines_of(spark, path).where(~is_blank(F.col("line")))
    return some.select("file", "line_no", F.try_parse_json("line").alias("value"))


def json_object(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def public_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Only the public part of a manifest."""
    return json_object(spark, path).select("public_metadata.*")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, document_id): SHA-256 of files' bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("document_id"))


def string_field(value: str, field: str) -> Column:
    """A string field of a VARIANT column, null if it is of another type."""
    v = F.try_variant_get(F.col(value), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(F.col(value), f"$.{field}", "string"))


def integer_field(value: str, field: str) -> Column:
    """An integer field of a VARIANT column, null if it is of another type; true and false are no integers."""
    v = F.try_variant_get(F.col(value), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(F.col(value), f"$.{field}", "bigint"))
