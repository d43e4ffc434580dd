"""Grouped summaries with fixed tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import exact_median


def mode_tie(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each key; ties go to the larger label."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("__n", value)).alias(name), F.max("__n").alias(f"{name}_n"))


def dominant(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, value, n, total) where one value makes up at least ``share`` of its key."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.withColumn("total", F.sum("n").over(W.partitionBy(*keys)))
    return total.where(F.col("n") >= F.col("total") * share)


def facet_rollup(df: DataFrame, levels: list[str], least: list[int], open_flag: Column) -> DataFrame:
    """Counts at every level of a hierarchy, each with its own threshold, in one shuffle."""
    sets = [levels[: k + 1] for k in range(len(levels))]
    base = df.withColumn("__open", open_flag.cast("long"))
    grouped = base.groupingSets([[F.col(c) for c in s] for s in sets], *levels).agg(F.count(F.lit(1)).alias("n"), F.sum("__open").alias("n_open"), F.grouping_id().alias("__g"))
    keep, level = F.lit(False), F.lit(0)
    for k in range(len(levels)):
        code = (1 << (len(levels) - 1 - k)) - 1
        keep = keep | ((F.col("__g") == code) & (F.col("n") >= least[k]))
        level = F.when(F.col("__g") == code, k + 1).otherwise(level)
    return grouped.where(keep).withColumn("level", level).drop("__g")


def price_facts(df: DataFrame, keys: list[str], price: str, is_free: Column, is_current: Column) -> DataFrame:
    """Counts of free, priced and unpriced current rows, with least, median and most price.

    The median is exact, rounded half up, and no task gathers a group for it.
    """
    priced = is_current & ~is_free & F.col(price).isNotNull()
    p = F.when(priced, F.col(price))
    facts = df.groupBy(*keys).agg(
        F.count_if(is_current).alias("n_current"),
        F.count_if(is_current & is_free).alias("n_free"),
        F.count_if(priced).alias("n_priced"),
        (F.count_if(is_current) - F.count_if(is_current & is_free) - F.count_if(priced)).alias("n_unpriced"),
        F.min(p).alias("min_price"),
        F.max(p).alias("max_price"),
    )
    middle = exact_median(df, keys, p, "__median").select(*[F.col(k).alias(f"__m_{k}") for k in keys], F.floor(F.col("__median") + 0.5).cast("long").alias("median_price"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__m_{k}"))
    return facts.join(middle, same, "left").drop(*[f"__m_{k}" for k in keys])


def collapse(df: DataFrame, keys: list[str], order: str, first: list[str], sets: list[str], largest: list[str]) -> DataFrame:
    """One row a key: the first row's fields, sorted distinct values, largest values."""
    return df.groupBy(*keys).agg(
        *[F.min_by(c, order).alias(c) for c in first],
        *[F.array_join(F.array_sort(F.collect_set(c)), "|").alias(f"{c}_set") for c in sets],
        *[F.max(c).alias(f"max_{c}") for c in largest],
    )


def latest(df: DataFrame, keys: list[str], by: str, order: str, fields: list[str]) -> DataFrame:
    """Fields of the row with the largest ``by``; of equals the first in order."""
    return df.groupBy(*keys).agg(F.max(by).alias(by), *[F.max_by(c, F.struct(F.col(by), -F.col(order))).alias(c) for c in fields])


#: How much each address precision is worth.
PRECISION = {"street": 4, "district": 3, "city": 2, "venue-name-only": 1, "none": 0}


def best_location(members: DataFrame, key: str, order: str) -> DataFrame:
    """(key, location): the most precise of the members' locations, the first of equals."""
    loc = F.col("location")
    precision = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRECISION.items() for x in kv]), loc["addressPrecision"]), F.lit(0))
    has = lambda c: F.coalesce((loc[c] != "").cast("int"), F.lit(0))
    score = precision * 10 + has("address") * 4 + has("district") * 2 + has("city")
    return members.where(loc.isNotNull()).groupBy(key).agg(F.max_by("location", F.struct(score, -F.col(order))).alias("location"))


def providers_of(df: DataFrame, keys: list[str], provider: str) -> DataFrame:
    """Providers by count, then name, with their rank."""
    counts = df.where(F.col(provider).isNotNull()).groupBy(*keys, provider).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), F.asc(provider))))


def city_summary(df: DataFrame, city: str, least: int, open_flag: Column) -> DataFrame:
    """Cities with at least so many rows, by size and then name."""
    out = df.where(F.col(city).isNotNull()).groupBy(city).agg(F.count(F.lit(1)).alias("n"), F.count_if(open_flag).alias("n_open"))
    return out.where(F.col("n") >= least).orderBy(F.desc("n"), F.asc(city))


def thin_groups(df: DataFrame, keys: list[str], ended: Column, most: int = 2) -> DataFrame:
    """Keys with few rows that have all ended."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_and(ended).alias("all_ended")).where(F.col("all_ended") & (F.col("n") <= most))


def changed_and_first(df: DataFrame, keys: list[str], changed: str, first: str) -> DataFrame:
    """Latest change and earliest sighting of each key."""
    return df.groupBy(*keys).agg(F.max(changed).alias("changed_at"), F.min(first).alias("first_seen"))


def by_rule(members: DataFrame, cluster: str, rule: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Rows by matching rule, and the number of clusters that more than one source shares."""
    rules = members.groupBy(rule).agg(F.count(F.lit(1)).alias("n"))
    shared = members.groupBy(cluster).agg(F.count_distinct(source).alias("s")).agg(F.count_if(F.col("s") > 1).alias("shared"), F.count_if(F.col("s") == 1).alias("single"))
    return rules, shared
