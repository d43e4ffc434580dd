"""Joins with hot keys: only those keys are spread over several partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

MOST_HOT = 100_000  # keys that are broadcast at most, about three megabytes
PER_SALT = 4096  # rows of one key in one partition


def hot_keys(counts: DataFrame, key: str | list[str], n: str = "n", per_salt: int | None = None) -> DataFrame | None:
    """(key.., __salts): the keys with most rows, at most ``MOST_HOT``; None if there are none.

    Any key that is left out has fewer than a ``MOST_HOT``-th of all rows.
    """
    per_salt = per_salt or PER_SALT
    hot = counts.where(F.col(n) > per_salt).orderBy(F.desc(n)).limit(MOST_HOT)
    hot = cut(hot.select(*([key] if isinstance(key, str) else key), F.ceil(F.col(n) / per_salt).cast("int").alias("__salts")), "hot")
    return None if hot.isEmpty() else hot


def spread_join(big: DataFrame, small: DataFrame, key: str | list[str], hot: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` by ``key``; rows of a hot key are dealt out by the hash of ``by``.

    ``small`` has few rows a key; those of a hot key are repeated once a salt.
    """
    if hot is None:
        return big.join(small, key, how)
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    dealt = big.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("__salts")
    copies = small.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(copies, [*([key] if isinstance(key, str) else key), "__salt"], how).drop("__salt")
