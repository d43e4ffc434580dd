"""Running state over sorted rows whose groups may be larger than a task.

Rows are sorted in ranges that samples set.  Each range works out its own state; the
state at the end of each range is carried over the ranges behind it, of which there are
as many as partitions; then every row takes the carried state into its own.  A group of
all rows is spread over all ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut


def _columns(order: list[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


KINDS = ("last", "first", "previous", "sum", "max", "min")


def running(df: DataFrame, keys: list[str], order: list[Column | str], values: dict[str, tuple[str, Column]], ranges: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``values``: name to (kind, value).

    Up to and with the row, in ``order`` inside its ``keys``: ``last`` and ``first`` are
    the last and first value that is there, ``sum``, ``max`` and ``min`` those of all
    values that are there; ``previous`` is the value of the row before, there or not.
    ``order`` has to be total inside a group; a null key is a key of its own.  ``ranges``
    is the number of ranges, that of Spark's shuffles by default.
    """
    if wrong := {k for k, _ in values.values()} - set(KINDS):
        raise ValueError(f"unknown kinds {sorted(wrong)}")
    names = list(values)
    kind = {n: values[n][0] for n in names}
    held = {f"__v{k}": F.struct(values[n][1].alias("v")) if kind[n] == "previous" else values[n][1] for k, n in enumerate(names)}
    sort = [*_columns(list(keys)), *_columns(order)]
    dealt = df.withColumns(held)
    dealt = dealt.repartitionByRange(ranges, *sort) if ranges else dealt.repartitionByRange(*sort)
    rows = cut(dealt.sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumn("__range", F.shiftrightunsigned("__at", 33)).withColumn("__key", F.struct(F.lit(0).alias("__none"), *keys))
    inside = W.partitionBy("__range", "__key").orderBy("__at")
    upto, before = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(W.unboundedPreceding, -1)
    fold = {"last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True), "previous": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "max": F.max, "min": F.min}
    own = {f"__s{k}": fold[kind[n]](f"__v{k}").over(before if kind[n] == "previous" else upto) for k, n in enumerate(names)}
    rows = rows.withColumns(own)

    end = lambda k, n: F.max_by(f"__v{k}" if kind[n] == "previous" else f"__s{k}", "__at").alias(f"__c{k}")
    ends = rows.groupBy("__range").agg(F.max_by("__key", "__at").alias("__key"), *[end(k, n) for k, n in enumerate(names)])
    so_far = W.partitionBy("__key").orderBy("__range").rowsBetween(W.unboundedPreceding, 0)
    ends = ends.withColumns({f"__c{k}": fold[kind[n]](f"__c{k}").over(so_far) for k, n in enumerate(names)})
    lag = lambda c: F.lag(c).over(W.orderBy("__range")).alias(c)  # noqa: E731  one row a range
    carried = ends.select("__range", lag("__key").alias("__from"), *[lag(f"__c{k}") for k in range(len(names))])

    met = rows.join(F.broadcast(carried), "__range")
    goes_on = F.col("__key").eqNullSafe(F.col("__from"))
    for k, n in enumerate(names):
        mine, theirs = F.col(f"__s{k}"), F.when(goes_on, F.col(f"__c{k}"))
        if kind[n] == "sum":
            both = F.coalesce(mine + theirs, mine, theirs)
        elif kind[n] in ("max", "min"):
            both = (F.greatest if kind[n] == "max" else F.least)(mine, theirs)
        else:
            both = F.coalesce(theirs, mine) if kind[n] == "first" else F.coalesce(mine, theirs)
        met = met.withColumn(n, both["v"] if kind[n] == "previous" else both)
    gone = ["__at", "__range", "__key", "__from", *[f"__{x}{k}" for x in "vsc" for k in range(len(names))]]
    return met.drop(*gone)
