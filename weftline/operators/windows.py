"""Row order within groups: keep-first, top-k, caps, chunks, fill-down, running state.

Ties never depend on input order: every function takes a full order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut
from .scan import running


def _nth(df: DataFrame, keys: list[str], order: list[Column], name: str = "__nth") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in order."""
    return _nth(df, keys, order).where("__nth = 1").drop("__nth")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; Spark cuts groups down before it shuffles them."""
    name = rank or "__nth"
    out = _nth(df, keys, order, name).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def top_k_spread(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str, by: list[str], per_task: int = 100_000) -> DataFrame:
    """``top_k`` for large k and groups of any size.

    While a group has more than ``per_task`` rows, its rows are dealt out by the hash of
    ``by`` and only the first k of each part go on; ``order`` has to be total.
    """
    at_most = lambda rows: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    largest = at_most(df)
    while largest > max(per_task, 2 * k):
        parts = -(-largest // max(per_task // 2, 2 * k))
        df = cut(top_k(df.withColumn("__part", F.pmod(F.xxhash64(*by), F.lit(parts))), [*keys, "__part"], order, k).drop("__part"), "top")
        largest = at_most(df)
    return top_k(df, keys, order, k, rank)


def capped_pick(df: DataFrame, dedupe: list[str], per: list[str], order: list[Column], each: int, most: int) -> DataFrame:
    """At most ``each`` rows of each group and ``most`` in all, duplicates left out first."""
    first = keep_first(df, dedupe, order)
    return top_k(first, per, order, each).orderBy(*order).limit(most)


def collision_flag(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Whether another row shares the key."""
    return df.withColumn(name, F.count(F.lit(1)).over(W.partitionBy(*keys)) > 1)


def row_numbers(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Each row's place in a total order, from 1.

    Rows are sorted in ranges that samples set; counts are added up over ranges, of which
    there are as many as partitions, so no task sees all rows.
    """
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumn("__range", F.shiftrightunsigned("__at", 33))
    sums = rows.groupBy("__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    shift = sums.select("__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    return rows.join(F.broadcast(shift), "__range").withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift")


def chunk_ids(df: DataFrame, order: list[Column], size: int, name: str) -> DataFrame:
    """Chunk number of each row in a total order, ``size`` rows to a chunk."""
    return row_numbers(df, order, "__nth").withColumn(name, F.ceil(F.col("__nth") / size).cast("long")).drop("__nth")


def fill_down(df: DataFrame, keys: list[str], order: list[Column], col: str, name: str) -> DataFrame:
    """The last value that is there, in a total order; groups may have any size."""
    return running(df, keys, order, {name: ("last", F.col(col))})


def first_known(df: DataFrame, keys: list[str], order: list[Column], col: str, name: str) -> DataFrame:
    """The first value that is there up to this row: state as of the row."""
    return running(df, keys, order, {name: ("first", F.col(col))})


def drop_ratio(df: DataFrame, keys: list[str], order: list[Column], col: str, name: str) -> DataFrame:
    """How far a value fell against the one before, as a share of that one."""
    last = F.col("__before")
    return running(df, keys, order, {"__before": ("previous", F.col(col))}).withColumn(name, F.when(last > 0, (last - F.col(col)) / last)).drop("__before")


def rows_of_max(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """All rows that hold their group's largest value."""
    best = df.groupBy(*keys).agg(F.max(col).alias("__max"))
    return df.join(best, keys).where(F.col(col) == F.col("__max")).drop("__max") if keys else df.crossJoin(F.broadcast(best)).where(F.col(col) == F.col("__max")).drop("__max")


def status_order(status: Column) -> Column:
    """open, upcoming, running, full, unknown, closed, cancelled, then the rest."""
    out = F.lit(9)
    for k, name in reversed(list(enumerate(("open", "upcoming", "running", "full", "unknown", "closed", "cancelled")))):
        out = F.when(status == name, k).otherwise(out)
    return out


def by_status_then_date(ended: Column, status: Column, start: Column) -> list[Column]:
    return [ended.asc(), status_order(status).asc(), F.coalesce(start, F.lit("")).desc()]


def by_enrol_deadline(status: Column, opens: Column, closes: Column, start: Column) -> list[Column]:
    phase = F.when(status == "open", 0).when(status == "upcoming", 1).otherwise(2)
    key = F.coalesce(F.when(status == "upcoming", opens).otherwise(closes), F.lit("9"))
    return [phase.asc(), key.asc(), F.coalesce(start, F.lit("9")).asc()]


def by_newest(first_seen: Column, start: Column, slug: Column) -> list[Column]:
    return [first_seen.desc_nulls_last(), start.desc_nulls_last(), slug.asc()]
