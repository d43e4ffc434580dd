"""Helpers for vector search: fit vectors, distinct ones, packed arrays."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """Whether a vector is there, is not empty and holds finite components only."""
    ok = F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ok, F.lit(False))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(vec, ids): each distinct vector with its ``most`` smallest ids, ascending.

    A vector that a third of all rows share is cut down to ``most`` ids in every
    task before it is shuffled.
    """
    key = rows.select("id", "vec").distinct().withColumn("key", F.xxhash64("vec"))
    first = F.row_number().over(W.partitionBy("key", "vec").orderBy("id"))
    few = key.withColumn("nth", first).where(F.col("nth") <= most)
    return few.groupBy("key", "vec").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("vec", "ids")


def matrix(col: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    if not len(col):
        return np.zeros((0, 0), kind)
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(col), -1)


def packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def unpacked(blobs, kind: type = np.float64) -> np.ndarray:
    blobs = list(blobs)
    if not blobs:
        return np.zeros((0, 0), kind)
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


MOST_LENGTHS = 64


def by_length(rows: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` among the vectors of each length, which have inner products only with each other.

    Raises an error that names the lengths if there are more than ``MOST_LENGTHS``.
    """
    sizes = [r["size"] for r in rows.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(MOST_LENGTHS + 1).collect()]
    if len(sizes) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths, among them {sorted(sizes)[:10]}")
    if len(sizes) <= 1:
        return search(rows)
    found = [search(rows.where(F.size("vec") == n)) for n in sizes]
    return functools.reduce(DataFrame.unionByName, found)


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
