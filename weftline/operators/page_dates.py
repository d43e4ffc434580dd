"""When pages last changed, from what is on them.

A page changes when a listing on it is added, removed or changed, not when it is fetched
again.  The table of what is on which page is kept from run to run; a run touches only the
pages that its changes lead to, and gives every other page its date back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def member_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(page, item) added to, removed from or changed on a page, of memberships (page, item, hash), unique by page and item."""
    o = old.select("page", "item", F.col("hash").alias("was"), F.lit(1).alias("before"))
    n = new.select("page", "item", "hash", F.lit(1).alias("now"))
    both = o.join(n, ["page", "item"], "full_outer")
    return both.where(F.col("before").isNull() | F.col("now").isNull() | ~F.col("was").eqNullSafe(F.col("hash"))).select("page", "item")


def apply_changes(dates: DataFrame, members: DataFrame, changes: DataFrame, today: Column) -> DataFrame:
    """(page, lastmod) after ``changes`` (page, ..) to the pages with ``dates`` (page, lastmod).

    ``members`` is what is on the pages now: a page without any is gone, a page without a
    date is new.
    """
    touched = changes.select("page").distinct().withColumn("touched", F.lit(True))
    there = members.select("page").distinct().withColumn("there", F.lit(True))
    rows = dates.join(touched, "page", "full_outer").join(there, "page", "full_outer").where("there")
    return rows.select("page", F.when(F.coalesce("touched", F.lit(False)) | F.col("lastmod").isNull(), today).otherwise(F.col("lastmod")).alias("lastmod"))


def item_changes(members: DataFrame, items: DataFrame) -> DataFrame:
    """(page, item): the pages that hold one of the changed ``items`` (item)."""
    return members.join(items.select("item").distinct(), "item", "left_semi").select("page", "item")


def full_dates(old: DataFrame, new: DataFrame, dates: DataFrame, today: Column) -> DataFrame:
    """The same from the two memberships alone, comparing every page's whole list."""
    signature = lambda df, name: df.groupBy("page").agg(F.count(F.lit(1)).alias(f"{name}_n"), F.sum(F.xxhash64("item", "hash").cast("decimal(38,0)")).alias(name))
    rows = signature(new, "s").join(signature(old, "o"), "page", "left").join(dates, "page", "left")
    same = F.col("s").eqNullSafe(F.col("o")) & F.col("s_n").eqNullSafe(F.col("o_n")) & F.col("lastmod").isNotNull()
    return rows.select("page", F.when(same, F.col("lastmod")).otherwise(today).alias("lastmod"))
