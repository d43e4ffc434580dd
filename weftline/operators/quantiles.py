"""Exact order statistics of groups of any size.

A group of at most ``SMALL`` rows is sorted in one task.  There are few larger ones; for
these the wanted ranks are narrowed down: each pass counts rows by group and by range of
the values still in question, inside tasks first, and keeps the range that holds the
rank, until no more than ``SMALL`` rows are left in it or all of them are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

SMALL = 10_000
RANGES = 1024


def _sorted_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The middle values of groups that fit a task: (keys, low, high)."""
    place = W.partitionBy(*keys)
    nth = rows.withColumn("__n", F.count(F.lit(1)).over(place)).withColumn("__k", F.row_number().over(place.orderBy("__v")))
    at = lambda k: F.max(F.when(F.col("__k") == k, F.col("__v")))
    return nth.groupBy(*keys).agg(at(F.floor((F.col("__n") + 1) / 2)).alias("low"), at(F.floor(F.col("__n") / 2) + 1).alias("high"))


def _narrowed(rows: DataFrame, wanted: DataFrame, keys: list[str], small: int, ranges: int) -> DataFrame:
    """(keys, which, value) of wanted (keys, which, rank); a few groups, each with very many rows."""
    ends = rows.groupBy(*keys).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count(F.lit(1)).alias("n"))
    open_ = cut(wanted.join(ends, keys), "ranks")
    found = None
    while True:
        done = open_.where(F.col("lo") == F.col("hi")).select(*keys, "which", F.col("lo").alias("value"))
        found = done if found is None else found.unionByName(done)
        few = open_.where((F.col("lo") < F.col("hi")) & (F.col("n") <= small))
        inside = lambda w: rows.join(_bounded(w), keys).where(F.col("__v").between(F.col("lo"), F.col("hi")))
        nth = F.row_number().over(W.partitionBy(*keys, "which").orderBy("__v"))
        found = found.unionByName(inside(few).withColumn("k", nth).where("k = rank").select(*keys, "which", F.col("__v").alias("value")))
        many = open_.where((F.col("lo") < F.col("hi")) & (F.col("n") > small))
        if many.isEmpty():
            return cut(found, "values")
        at = F.least(F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * ranges), F.lit(ranges - 1))
        counts = inside(many).groupBy(*keys, "which", "rank", at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        upto = F.sum("n").over(W.partitionBy(*keys, "which").orderBy("at"))  # at most ``ranges`` rows
        next_ = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        open_ = cut(next_.select(*keys, "which", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi", "n"), "ranks")


def _bounded(few: DataFrame, most: int = 100_000) -> DataFrame:
    return F.broadcast(few) if few.count() <= most else few


def exact_median(df: DataFrame, keys: list[str], value: Column, name: str = "median", small: int = SMALL, ranges: int = RANGES) -> DataFrame:
    """(keys, name): the median of each group's values that are there, as a double.

    Null keys are groups of their own; groups without a value are left out, values that
    are no number too.  No task holds more than ``small`` rows of a group.
    """
    # as JSON a null key meets itself in joins
    parts = [F.to_json(F.struct(F.col(k).alias("k"))).alias(f"__k{i}") for i, k in enumerate(keys)] or [F.lit("").alias("__k0")]
    cols = [f"__k{i}" for i in range(len(parts))]
    rows = cut(df.select(*keys, *parts, value.cast("double").alias("__v")).where("__v is not null and not isnan(__v)"), "values")
    sizes = cut(rows.groupBy(*cols).agg(*[F.first(k).alias(k) for k in keys], F.count(F.lit(1)).alias("n")), "sizes")
    plain = rows.select(*cols, "__v")
    large = sizes.where(F.col("n") > small).select(*cols, "n")
    if large.isEmpty():
        middle = _sorted_groups(plain, cols)
    else:
        ranks = F.array(F.struct(F.lit("low").alias("which"), F.floor((F.col("n") + 1) / 2).alias("rank")), F.struct(F.lit("high").alias("which"), (F.floor(F.col("n") / 2) + 1).alias("rank")))
        wanted = large.select(*cols, F.explode(ranks).alias("w")).select(*cols, "w.which", "w.rank")
        of_large = plain.join(_bounded(large.select(*cols)), cols, "left_semi")
        values = _narrowed(of_large, wanted, cols, small, ranges)
        pick = lambda w: F.max(F.when(F.col("which") == w, F.col("value"))).alias(w)
        middle = values.groupBy(*cols).agg(pick("low"), pick("high"))
        middle = middle.unionByName(_sorted_groups(plain.join(_bounded(large.select(*cols)), cols, "left_anti"), cols))
    return sizes.join(middle, cols).select(*keys, ((F.col("low") + F.col("high")) / 2).alias(name))

