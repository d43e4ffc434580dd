"""Sinks: sorted line files, chunked sitemaps, positional rows, linked-data documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import xml_escape
from ..operators.windows import chunk_ids


def write_ndjson(df: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """JSON lines in key order: range-partitioned and sorted, so no task sees all rows."""
    n = files or max(1, df.rdd.getNumPartitions())
    df.repartitionByRange(n, key).sortWithinPartitions(key).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_raw(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, optionally laid out by columns that later filters use."""
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def sitemap(urls: DataFrame, size: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(entries, index): url elements in binary order of ``loc`` by file, and each file's last change."""
    rows = chunk_ids(urls, [F.col("loc")], size, "file")
    entry = F.concat(F.lit("<url><loc>"), xml_escape(F.col("loc")), F.lit("</loc>"), F.when(F.col("lastmod").isNotNull(), F.concat(F.lit("<lastmod>"), F.col("lastmod"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))
    entries = rows.select("file", "loc", entry.alias("value"))
    return entries, rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("lastmod").alias("lastmod"))


def write_sitemap(entries: DataFrame, path: str) -> None:
    entries.repartition("file").sortWithinPartitions("file", "loc").select("file", "value").write.mode("overwrite").partitionBy("file").text(path)


def positional(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as JSON arrays in a fixed column order."""
    cell = lambda c: F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("{}"))
    value = lambda c: F.coalesce(F.nullif(F.regexp_extract(cell(c), r'(?s)^\{"v":(.*)\}$', 1), F.lit("")), F.lit("null"))
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *[value(c) for c in columns]), F.lit("]")).alias("value"))


def upload_batches(df: DataFrame, order: list[Column], size: int, path: str) -> None:
    """CSV files of at most ``size`` rows, with a byte order mark in the header and CRLF ends."""
    rows = chunk_ids(df, order, size, "batch")
    first = df.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").partitionBy("batch").option("header", True).option("lineSep", "\r\n").csv(path)


def json_ld(kind: str, fields: dict[str, Column]) -> Column:
    """A linked-data document; missing fields are left out."""
    parts = [F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type")]
    return F.to_json(F.struct(*parts, *[F.when(c.cast("string") != "", c).alias(n) for n, c in fields.items()]))
