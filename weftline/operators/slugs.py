"""An append-only slug ledger: known ids keep theirs, new ones get the shortest free suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

LENGTHS = (5, 6, 7, 8)


def assign_slugs(items: DataFrame, ledger: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(id, slug, length) for items (id, base) that the ledger (id, slug) does not hold.

    A slug is the base and the first hex digits (``lengths``) of a hash of the id.  Items
    are served in id order; one whose shortest slug is taken (ignoring case) by
    the ledger, or by an item before it at any length tried so far, tries the next
    length.  Items that run out of lengths stay without a slug.
    """
    todo = cut(items.join(ledger.select("id"), "id", "left_anti").withColumn("seed", F.sha2("id", 256)))
    taken = ledger.select(F.lower("slug").alias("folded")).distinct()
    done = None
    for n in lengths:
        made = todo.withColumn("slug", F.concat_ws("-", "base", F.substring("seed", 1, n))).withColumn("folded", F.lower("slug"))
        first = F.row_number().over(W.partitionBy("folded").orderBy("id"))
        free = cut(made.join(taken, "folded", "left_anti").withColumn("nth", first).where("nth = 1").select("id", "slug", "folded", F.lit(n).alias("length")))
        done = free if done is None else done.unionByName(free)
        taken = taken.unionByName(free.select("folded"))
        todo = cut(todo.join(free.select("id"), "id", "left_anti"))
        if todo.isEmpty():
            break
    rest = todo.select("id", F.lit(None).cast("string").alias("slug"), F.lit(None).cast("int").alias("length"))
    return done.select("id", "slug", "length").unionByName(rest)
