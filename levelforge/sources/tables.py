"""JSON, CSV and report sinks with the reference formats' habits: tolerant reads, BOMs, blanks for nulls."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.levels import html_escape, json_number


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = False, defaults: dict | None = None) -> DataFrame:
    """One document a file, and its path (column path).

    Strict: a damaged file raises. Tolerant: it gives no row, or, with
    ``defaults``, a row of those values (null for the rest); what a whole file
    leaves out takes them too.
    """
    read = spark.read.schema(schema).option("multiLine", True)
    if strict:
        return read.option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))
    if defaults is None:
        return read.option("mode", "DROPMALFORMED").json(path).withColumn("path", F.col("_metadata.file_path"))
    files = spark.read.format("binaryFile").load(path).select("path", F.from_json(F.decode("content", "UTF-8"), schema).alias("d"))
    return files.select(*(F.coalesce(F.col(f"d.`{f.name}`"), F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name) for f in files.schema["d"].dataType), "path")


def check_json(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """(path, error) of JSON files: where the text breaks off being JSON (line and column), or which top-level objects it lacks; null where it is sound."""

    def run(frames):
        for frame in frames:
            out = []
            for name, content in frame.itertuples(index=False):
                try:
                    value = json.loads(content.decode("utf-8-sig"))
                    lacks = [k for k in required if not isinstance(value.get(k), dict)] if isinstance(value, dict) else required
                    out.append((name, f"missing objects: {', '.join(lacks)}" if lacks else None))
                except json.JSONDecodeError as e:
                    out.append((name, f"{e.msg}: line {e.lineno} column {e.colno}"))
                except (UnicodeDecodeError, RecursionError) as e:
                    out.append((name, type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, error string")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report CSV with a header, its byte-order mark removed from the first name."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def write_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """A report CSV of fixed columns in their order: absent ones are blank, others are left out."""
    rows = df.select(*((F.col(c) if c in df.columns else F.lit("")).alias(c) for c in columns)).fillna("")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _has_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_floats(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _has_floats(kind.elementType)
    return _has_floats(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, T.DoubleType | T.FloatType)


def safe_value(c: Column, kind: T.DataType) -> Column:
    """``c`` with non-finite numbers as null, however deep in structs, arrays and map values; null structs stay null, parts without floats are as they were."""
    if not _has_floats(kind):
        return c
    if isinstance(kind, T.StructType):
        inner = F.struct(*(safe_value(c.getField(f.name), f.dataType).alias(f.name) for f in kind))
        return F.when(c.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: safe_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: safe_value(v, kind.valueType))
    return json_number(c)


def json_safe(df: DataFrame) -> DataFrame:
    """Every column's non-finite numbers as null, by its type."""
    return df.select(*(safe_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def to_json_lines(df: DataFrame) -> DataFrame:
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in safe.columns)), {"ignoreNullFields": "false"}).alias("value"))


def html_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One escaped table row for each row: write with ``.write.text`` between a head and a foot of your own."""
    cells = [F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


#: Fixed frame of a report page.
PAGE = '<!doctype html><html><head><meta charset="utf-8"><title>%s</title></head><body><h1>%s</h1><p>%s</p><table><tr>%s</tr>%s</table></body></html>'


def quality_json(df: DataFrame, batch: str, *order: str) -> DataFrame:
    """(batch, value): the batch's rows as one JSON array, non-finite numbers null; a batch is one release, some dozen tracks."""
    safe = json_safe(df)
    rest = [c for c in safe.columns if c != batch]
    row = F.struct(*(F.col(f"`{c}`") for c in [*order, *(c for c in rest if c not in order)]))
    each = safe.groupBy(batch).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return each.select(batch, F.to_json("rows", {"ignoreNullFields": "false"}).alias("value"))


def quality_pages(df: DataFrame, batch: str, status: str, columns: list[str], title: str) -> DataFrame:
    """(batch, value): a page with the counts of each status and an escaped table of the batch's rows in the order of ``columns``."""
    cells = F.concat(*(F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns))
    row = F.struct(*(F.col(c) for c in columns), F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("row__"))
    count = lambda s: F.count_if(F.col(status) == s)
    each = df.groupBy(batch).agg(F.array_sort(F.collect_list(row)).alias("rows"), count("PASS").alias("passed"), count("WARN").alias("warned"), count("FAIL").alias("failed"))
    counts = F.format_string("PASS %d / WARN %d / FAIL %d", "passed", "warned", "failed")
    head = F.lit("".join(f"<th>{c}</th>" for c in columns))
    name = html_escape(F.lit(title))
    return each.select(batch, F.format_string(PAGE, name, name, counts, head, F.array_join(F.transform("rows", lambda r: r["row__"]), "")).alias("value"))


def error_traces(df: DataFrame, track: str, error: str, keep: int = 10_000) -> DataFrame:
    """(track, value): the last ``keep`` characters of each error that there is."""
    return df.where(F.col(error).isNotNull()).select(track, F.right(error, F.lit(keep)).alias("value"))


def renew_version(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(path, value): whole text files with every version (v1.2.3) replaced."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.withColumn("value", F.regexp_replace("value", r"\bv[0-9]+(\.[0-9]+)*\b", version))


def write_release(df: DataFrame, path: str) -> None:
    """Rows by their release_bucket, a folder each."""
    df.write.mode("overwrite").partitionBy("release_bucket").parquet(path)
