"""Readers over landed files, and table functions on markup.

Fetching stays outside: a source is the files that a fetch has landed.  Readers
return what the files hold, with no renames and no casts.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """A registered source: its id, the kind of its records, how often it changes, its reader."""

    id: str
    entity: str
    cadence: str
    read: Callable[[SparkSession, str], DataFrame]


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that holds one JSON array of records."""
    r = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r).json(path)


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON record a line; a folder is read as the union of its files, blank lines are skipped."""
    return spark.read.schema(schema).option("ignoreMissingFiles", True).json(path)


def csv_table(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Quoted CSV with embedded line breaks; every field is text, a short row's rest is empty."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding).option("nullValue", "\0").option("emptyValue", "").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.fillna("").where(~_blank(df.columns))


def _blank(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) == "")
    return out


def csv_decoded(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """CSV in an encoding that Spark's reader does not know: each file is decoded in its task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = [r for r in csv.reader(io.StringIO(bytes(content).decode(encoding, "replace"))) if any(x.strip() for x in r)]
                yield pd.DataFrame({"n": range(len(rows)), "cells": rows})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "n int, cells array<string>")
    names = [c.lstrip("\ufeff").strip() for c in rows.where("n = 0").first()["cells"]]
    return rows.where("n > 0").select(*[F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(names)])


def csv_any_encoding(spark: SparkSession, path: str, fallback: str = "cp950") -> DataFrame:
    """UTF-8, or the fallback if a file has characters that UTF-8 cannot decode."""
    df = csv_table(spark, path)
    broken = F.lit(any("\ufffd" in c for c in df.columns))
    for c in df.columns:
        broken = broken | F.contains(F.col(f"`{c}`"), F.lit("\ufffd"))
    return df if df.where(broken).isEmpty() and not any("\ufffd" in c for c in df.columns) else csv_decoded(spark, path, fallback)


def parse_json_loose(text: Column, schema: str) -> Column:
    """JSON after a byte order mark and white space are gone; empty text gives null."""
    clean = F.regexp_replace(text, "^[﻿\\s]+", "")
    return F.when(clean != "", F.from_json(clean, schema))


def with_lineage(df: DataFrame, name: str = "_file") -> DataFrame:
    return df.withColumn(name, F.col("_metadata.file_name"))


def union_kinds(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of tables with a column ``_kind`` that says which one a row came from."""
    out = None
    for kind, df in parts.items():
        df = df.withColumn("_kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def live(observations: DataFrame) -> DataFrame:
    """Observations that have not disappeared."""
    return observations.where(F.col("disappearedAt").isNull())


def blocks(df: DataFrame, html: str, pattern: str, out: str = "block", position: str = "pos") -> DataFrame:
    """One row for each repeated block of markup, in document order."""
    found = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    return df.select(*[c for c in df.columns if c != html], F.posexplode(found).alias(position, out))


def fields(df: DataFrame, block: str, patterns: dict[str, str]) -> DataFrame:
    """Named fields of a block, each the first group of its pattern; missing ones are empty."""
    return df.withColumns({name: F.trim(F.regexp_extract(F.col(block), p, 1)) for name, p in patterns.items()})


def labelled(block: Column, label: str, stops: tuple[str, ...] = ()) -> Column:
    """The text after ``label`` and a colon, up to a line break, a tag or a stop word."""
    end = "|".join(["$", r"[\n<]", *stops])
    return F.trim(F.regexp_extract(block, rf"{label}\s*[:：]\s*(.*?)\s*(?:{end})", 1))


def grid(df: DataFrame, keys: list[str], table: str, header: str = r"(?is)<th[^>]*>(.*?)</th>", row: str = r"(?is)<tr[^>]*>(.*?)</tr>", cell: str = r"(?is)<td[^>]*>(.*?)</td>") -> DataFrame:
    """(keys, line, column, heading, cell): every cell of a table with its column's heading."""
    heads = F.regexp_extract_all(F.col(table), F.lit(header), F.lit(1))
    rows = df.select(*keys, heads.alias("heads"), F.posexplode(F.regexp_extract_all(F.col(table), F.lit(row), F.lit(1))).alias("line", "tr"))
    cells = rows.select(*keys, "line", "heads", F.posexplode(F.regexp_extract_all("tr", F.lit(cell), F.lit(1))).alias("column", "cell"))
    return cells.select(*keys, "line", "column", F.trim(F.get("heads", F.col("column"))).alias("heading"), F.trim("cell").alias("cell"))


def carried_headers(df: DataFrame, keys: list[str], pieces: str, header: str, item: str) -> DataFrame:
    """(keys, pos, header, item): items in document order under the last header before them."""
    both = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(pieces), F.lit(f"(?s)({header}|{item})"), F.lit(1))).alias("pos", "piece"))
    w = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("h", F.nullif(F.regexp_extract("piece", f"(?s)^{header}$", 1), F.lit("")))
    return both.withColumn("header", F.last("h", ignorenulls=True).over(w)).where("h is null").select(*keys, "pos", "header", F.col("piece").alias("item"))


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """(item map): the children of every feed item, tag to text, whatever tags there are."""
    raw = spark.read.option("wholetext", True).text(path)
    items = raw.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<item[^>]*>(.*?)</item>"), F.lit(1))).alias("item"))
    tags = F.regexp_extract_all("item", F.lit(r"(?is)<([\w:]+)[^>]*>.*?</\1>"), F.lit(1))
    texts = F.transform(F.regexp_extract_all("item", F.lit(r"(?is)<([\w:]+)[^>]*>(.*?)</\1>"), F.lit(2)), lambda x: F.trim(F.regexp_replace(x, r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")))
    return items.select(F.map_from_entries(F.array_distinct(F.arrays_zip(tags.alias("k"), texts.alias("v")))).alias("item"))


def rows_until(df: DataFrame, page: str, day: str, cutoff: str) -> DataFrame:
    """Pages up to and including the first whose oldest day lies before the cutoff."""
    stop = df.groupBy(page).agg(F.min(day).alias("__old")).where(F.col("__old") < cutoff).agg(F.min(page).alias("__stop"))
    return df.crossJoin(F.broadcast(stop)).where(F.col("__stop").isNull() | (F.col(page) <= F.col("__stop"))).drop("__stop")
