"""Cutting a total order into files with two limits at once: rows and bytes.

A file takes rows as long as both limits hold.  Where it ends depends on where it began,
so files look sequential; but the file that *would* begin at a row, and with it the first
row of the next one, is known for every row from sums of what comes before it.  Following
these pointers by doubling from the first row marks the rows that really begin files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut, drop
from .scan import running
from .windows import row_numbers


def next_starts(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """(nth, next) of rows (nth, upto, bytes): where the file after the one that begins at ``nth`` begins.

    ``upto`` is the sum of bytes up to and with the row.  A row larger than the limit is a
    file of its own.
    """
    # the last row whose sum stays within the limit: rows and limits in one order of bytes
    marks = rows.select(F.col("upto").alias("at"), F.lit(0).alias("ask"), "nth")
    asks = rows.select((F.col("upto") - F.col("bytes") + most_bytes).alias("at"), F.lit(1).alias("ask"), "nth")
    met = running(marks.unionByName(asks), [], ["at", "ask", "nth"], {"fits": ("max", F.when(F.col("ask") == 0, F.col("nth")))})
    by_bytes = F.coalesce(F.col("fits"), F.lit(0)) + 1
    return met.where("ask = 1").select("nth", F.greatest(F.least(by_bytes, F.col("nth") + most_rows), F.col("nth") + 1).alias("next"))


def reached(pointers: DataFrame, first: int = 1) -> DataFrame:
    """(nth): the rows that following ``pointers`` (nth, next) from ``first`` comes by."""
    jump = cut(pointers, "jump")
    last = jump.agg(F.max("nth")).first()[0]
    seen = pointers.sparkSession.createDataFrame([(first,)], "nth long")
    if last is None:
        return seen.limit(0)
    while True:
        ahead = seen.join(jump, "nth").select(F.col("next").alias("nth")).where(F.col("nth") <= last)
        if ahead.isEmpty():
            return seen
        seen = cut(seen.unionByName(ahead), "seen")
        twice = jump.join(jump.select(F.col("nth").alias("next"), F.col("next").alias("after")), "next").select("nth", F.col("after").alias("next"))
        after = cut(twice, "jump")
        drop(jump)
        jump = after


def file_numbers(df: DataFrame, order: list[Column], size: Column, most_rows: int, most_bytes: int, name: str = "file") -> DataFrame:
    """``df`` with the number, from 1, of the file each row goes to.

    ``order`` is total; ``size`` is a row's bytes, a null size counts as none.  Files are
    as few as files that take all they can hold, in this order.
    """
    rows = row_numbers(df.withColumn("__bytes", F.coalesce(size.cast("long"), F.lit(0))), order, "__nth")
    rows = cut(running(rows, [], ["__nth"], {"__upto": ("sum", F.col("__bytes"))}), "sized")
    starts = reached(next_starts(rows.select(F.col("__nth").alias("nth"), F.col("__upto").alias("upto"), F.col("__bytes").alias("bytes")), most_rows, most_bytes))
    marked = rows.join(starts.select(F.col("nth").alias("__nth"), F.lit(1).alias("__starts")), "__nth", "left")
    return running(marked, [], ["__nth"], {name: ("sum", F.col("__starts").cast("long"))}).drop("__nth", "__bytes", "__upto", "__starts")
