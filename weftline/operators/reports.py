"""Small parts of reports: whitelists, shared activities, dominant prefixes, seat sums, link lists, state documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerals import norm_address

#: Fixed value: how listings without a county are shown.
NO_CITY = "未標示縣市"


def whitelisted(pages: DataFrame, path: Column, listed: DataFrame, paused: Column) -> DataFrame:
    """Pages of a paused kind stay only if their path is ``listed`` (path); all others stay."""
    rows = pages.withColumn("__path", path)
    keep = rows.join(listed.select(F.col("path").alias("__path")).distinct(), "__path", "left_semi").where(paused)
    return keep.unionByName(rows.where(~F.coalesce(paused, F.lit(False)))).drop("__path")


def others(rows: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the current ones."""
    return rows.join(current.select(key).distinct(), key, "left_anti")


def shares_any(a: Column, b: Column) -> Column:
    """Whether two lists have a value in common; null lists share nothing."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def dominant_prefix(df: DataFrame, keys: list[str], title: str, word: str, order: str, share: float = 0.5) -> DataFrame:
    """(keys, prefix, n, total): what stands before ``word`` in more than ``share`` of a key's titles.

    Up to four letters or digits right before the word; of equals the one seen first in
    ``order``.  Titles without one count in the total.
    """
    pattern = F.concat(F.lit("([一-鿿A-Za-z0-9]{1,4})\\Q"), F.col(word), F.lit("\\E"))
    found = F.call_function("regexp_extract", F.col(title), pattern, F.lit(1))
    rows = df.select(*keys, F.nullif(found, F.lit("")).alias("prefix"), order)
    counts = rows.groupBy(*keys, "prefix").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.max_by(F.struct("prefix", "n"), F.when(F.col("prefix").isNotNull(), F.struct("n", (-F.col("first")).alias("f"))))
    out = counts.groupBy(*keys).agg(best.alias("best"), F.sum("n").alias("total"))
    return out.where(F.col("best.n") > F.col("total") * share).select(*keys, "best.prefix", "best.n", "total")


def type_counts(df: DataFrame, page: str, kinds: Column) -> DataFrame:
    """(kind, n, pages) over an array of kinds a page: occurrences, and pages that have it."""
    rows = df.select(F.col(page).alias("page"), F.explode(kinds).alias("kind"))
    return rows.groupBy("page", "kind").agg(F.count(F.lit(1)).alias("k")).groupBy("kind").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("pages"))


def by_usage(current: str, n: str, slug: str) -> list[Column]:
    """Venues in use first, then those with most listings, then by address."""
    return [F.col(current).desc(), F.col(n).desc(), F.col(slug).asc()]


def open_by_city(df: DataFrame, city: str, open_flag: Column) -> DataFrame:
    """(city, n): open listings by county, those without one under a name of their own."""
    return df.where(open_flag).groupBy(F.coalesce(F.nullif(F.col(city), F.lit("")), F.lit(NO_CITY)).alias("city")).agg(F.count(F.lit(1)).alias("n"))


def seat_sums(df: DataFrame, keys: list[str], available: str, status: str, verified: str) -> DataFrame:
    """(keys, seats, n_full, n_known, verified): free seats where they are known, full listings, the last look."""
    return df.groupBy(*keys).agg(F.sum(available).alias("seats"), F.count_if(F.col(status) == "full").alias("n_full"), F.count(available).alias("n_known"), F.max(verified).alias("verified"))


def hub_links(hubs: DataFrame, city: str, kind: str, order: str, text: Column, href: Column, n: str) -> DataFrame:
    """(city, links): for each city the special pages it has, in order, as (text, href, n)."""
    link = F.struct(F.col(order).alias("o"), F.col(kind).alias("k"), text.alias("text"), href.alias("href"), F.col(n).alias("n"))
    out = hubs.where(F.col(n) > 0).groupBy(city).agg(F.sort_array(F.collect_list(link)).alias("l"))  # one row a kind
    return out.select(city, F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["href"].alias("href"), x["n"].alias("n"))).alias("links"))


def geocode_lookup(lines: DataFrame, line: str, order: str) -> DataFrame:
    """(key, lat, lng) of lines "address,lat,lng,..": split at every comma, the last line of a key wins.

    A byte order mark is dropped; lines without two finite numbers or an address say nothing.
    """
    part = F.split(F.regexp_replace(F.col(line), "^﻿", ""), ",")
    real = lambda k: F.when(F.trim(F.get(part, F.lit(k))).rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"), F.get(part, F.lit(k)).try_cast("double"))
    rows = lines.select(norm_address(F.get(part, F.lit(0))).alias("key"), real(1).alias("lat"), real(2).alias("lng"), order).where("key <> '' and lat is not null and lng is not null")
    return rows.groupBy("key").agg(F.max_by(F.struct("lat", "lng"), order).alias("at")).select("key", "at.lat", "at.lng")


def unresolved(rows: DataFrame, key: str, resolved: DataFrame) -> DataFrame:
    """(key, n): keys that no answer resolves, most listings first."""
    left = rows.where(F.coalesce(F.col(key) != "", F.lit(False))).join(resolved.select(key).distinct(), key, "left_anti")
    return left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def state_document(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, value): one JSON object a row, its fields in the order of their names, null ones left out."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[F.col(f) for f in sorted(fields)])).alias("value"))
