"""Reading and writing of CSV, JSON lines, keyed and nested JSON, and JSON inside HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; UTF-8 with or without a byte order mark; quoted fields may span lines. Empty fields are NULL."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', inferSchema=False)
    return df.toDF(*(c.removeprefix(BOM) for c in df.columns))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """One object per line, blank lines skipped. A malformed line is an error (strict) or stays in _corrupt_record, with its file."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.schema(full).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record").withColumn("_file", F.input_file_name())
    return lines_checked(df, fields).drop("_file") if strict else df


def lines_checked(df: DataFrame, fields: T.StructType) -> DataFrame:
    """`df` without _corrupt_record, whatever columns are read later: a malformed line is an error with its file."""
    first = F.coalesce(F.nullif(F.to_json(F.struct(fields.fields[0].name)), F.lit("{}")), F.lit(""))  # a column of the data has to be read beside the record
    bad = F.raise_error(F.concat(F.lit("malformed line in "), F.col("_file"), F.lit(": "), F.col("_corrupt_record"), first))
    return df.where(F.when(F.col("_corrupt_record").isNotNull(), bad.cast("boolean")).otherwise(F.lit(True))).drop("_corrupt_record")


def read_jsonl_shards(spark: SparkSession, globs: list[str], schema: str, strict: bool = True) -> DataFrame:
    """Union of all files that match, each once, with their name as `shard`. A pattern without a match is Spark's own error.

    No line is lost: blank ones are skipped, fields may be NULL, and a malformed line is an error (strict) or a row with
    its text in _corrupt_record.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    df = read_jsonl(spark, sorted(set(globs)), fields, strict=False)
    df = df.withColumn("shard", F.element_at(F.split("_file", "/"), -1))
    return (lines_checked(df, fields) if strict else df).drop("_file")


def embedded_json(html: Column, start: str, end: str, schema: str) -> Column:
    """The JSON payload between two markers of a page."""
    import re

    payload = F.regexp_extract(html, f"(?s){re.escape(start)}(.*?){re.escape(end)}", 1)
    return F.from_json(F.nullif(payload, F.lit("")), schema)


def read_embedded_json(spark: SparkSession, path: str, start: str, end: str, schema: str) -> DataFrame:
    pages = spark.read.text(path, wholetext=True)
    return pages.select(F.input_file_name().alias("file"), embedded_json(F.col("value"), start, end, schema).alias("payload"))


def keyed_documents(docs: DataFrame, text: str, value_schema: str) -> DataFrame:
    """Rows (id, value) of documents {metadata, annotations: {id: object}}; an id in two documents is an error."""
    parsed = docs.select(F.from_json(text, f"metadata MAP<STRING, BIGINT>, annotations MAP<STRING, STRUCT<{value_schema}>>").alias("d"))
    rows = parsed.select(F.explode("d.annotations").alias("id", "value"))
    once = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"))
    return once.select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate id "), "id")).cast("string")).otherwise(F.col("id")).alias("id"), "value")


def summed_metadata(docs: DataFrame, text: str) -> DataFrame:
    """Counters of all documents' metadata, summed."""
    parsed = docs.select(F.explode(F.from_json(text, "metadata MAP<STRING, BIGINT>").getField("metadata")).alias("counter", "n"))
    return parsed.groupBy("counter").agg(F.sum("n").alias("n"))


def flatten_nested(records: DataFrame, line: str, steps: str) -> DataFrame:
    """One row per completion of nested records: line, step, completion index, chosen flag, text, valence."""
    s = records.select(F.col(line).alias("line"), F.posexplode(steps).alias("step_index", "step"))
    c = s.select("line", "step_index", F.col("step.chosen_completion").alias("chosen"), F.posexplode("step.completions").alias("completion_index", "completion"))
    return c.select("line", "step_index", "completion_index", (F.col("completion_index") == F.col("chosen")).alias("is_chosen"), "completion.text", "completion.valence")


def ordered_columns(df: DataFrame, fields: list[str], strict: bool = False) -> DataFrame:
    """The given columns in order; strict refuses others, and missing ones are always an error."""
    if strict and (extra := set(df.columns) - set(fields)):
        raise ValueError(f"unexpected columns: {sorted(extra)}")
    return df.select(*fields)


def write_csv(df: DataFrame, path: str, fields: list[str], strict: bool = False) -> None:
    ordered_columns(df, fields, strict).write.csv(path, header=True, escape='"', quote='"')


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def summary_document(metrics: dict[str, DataFrame]) -> DataFrame:
    """One JSON document with a list of rows per named metric. For reports: metrics are small results, gathered by one row each."""
    out = None
    for name, df in metrics.items():
        part = df.agg(F.sort_array(F.collect_list(F.to_json(F.struct(*df.columns)))).alias(name))
        out = part if out is None else out.crossJoin(part)  # single rows
    return out.select(F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":['), F.array_join(n, ","), F.lit("]")) for n in metrics)), F.lit("}")).alias("document"))


def shard_assign(df: DataFrame, order: str, n: int) -> DataFrame:
    """Shard of each row by its display order."""
    return df.withColumn("shard", F.pmod(F.col(order) - 1, F.lit(n)).cast("int"))
