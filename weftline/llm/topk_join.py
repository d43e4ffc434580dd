"""Exact top-k inner products by a Voronoi kNN join.

The k largest inner products are the k nearest neighbours once every data vector
x gets one more component, ``sqrt(M - |x|^2)`` (M the largest squared norm), and
every query a zero there.  In that space:

1. Pivots come from a bounded sample of distinct vectors.  Data and queries go to
   the cell of their nearest pivot.
2. Summaries: of each data cell its count and its k smallest distances to the
   pivot; of each query group its radius.  They are a few numbers a pivot.
3. Per group, the k-th smallest of ``radius + |pivot, pivot'| + distance`` over
   all summaries bounds every query's k-th neighbour.  A data vector is replicated
   to a group only if the triangle inequality allows it within that bound.
4. Cells and groups are cut into blocks of a fixed number of rows; every pair of
   a query block and a data block is solved locally and exactly, and the partial
   answers are merged by query.

Equal vectors count once, with their smallest ids, so a hot vector costs what
any other does; queries with equal vectors are solved once.

Distances are computed in double precision from squares; ``slack`` bounds their error
by the norms that occur, and every comparison with a bound leaves that much room, so
rounding never prunes an answer.

Edge cases: null, empty and non-finite vectors take no part, nor do null ids.  Vectors of
several lengths are searched length by length, as they have no inner product with others.
Rows equal in id and vector count once.  A query whose table holds nothing else returns
no rows, and an empty table none.  Scores beyond a long wrap.  Other columns of the
table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import cut, table
from .vectors import by_length, chunks, distinct_vectors, finite, matrix, packed, unpacked

K = 5
BLOCK = 4096
SAMPLE = 4096
MOST_PIVOTS = 256
EPS = 2.0**-52


def pivots_of(sample: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n centres of a sample, spread out and then moved to their cells' means."""
    if not len(sample):
        return sample
    n = min(n, len(sample))
    centres = sample[:: max(1, len(sample) // n)][:n].copy()
    for _ in range(rounds):
        near = np.argmin(-2 * sample @ centres.T + (centres**2).sum(1), axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = sample[near == c].mean(axis=0)
    return centres


def slack(pivots: np.ndarray, most: float) -> float:
    """How far a computed distance can be from the true one.

    A squared distance is a sum of at most 3 * dim products of numbers whose squares are
    at most the largest squared norm; each rounds by EPS, and so do the sums.  The error
    of the root is at most the root of the error.
    """
    largest = max(most, float((pivots**2).sum(axis=1).max()) if len(pivots) else 0.0)
    return float(np.sqrt(16 * (pivots.shape[1] + 4) * EPS * largest))


def lifted(x: np.ndarray, most: float, query: bool) -> np.ndarray:
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))
    return np.concatenate([x, last[:, None]], axis=1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole inner products; in double precision where that is exact."""
    if len(q) and len(x) and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _assign(rows: DataFrame, pivots: np.ndarray, most: float, query: bool, keep: str) -> DataFrame:
    """(vec, keep, cell, far): packed vectors with their nearest pivot and distance."""
    spread = rows.sparkSession.sparkContext.broadcast(pivots)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, BLOCK):
            x = matrix(batch.column(0), np.int64)
            wide = lifted(x.astype(np.float64), most, query)
            gap = (wide * wide).sum(1)[:, None] - 2 * wide @ spread.value.T + (spread.value**2).sum(1)
            cell = np.argmin(gap, axis=1)
            far = np.sqrt(np.maximum(0, gap[np.arange(len(cell)), cell]))
            yield pa.RecordBatch.from_arrays([packed(x), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(far)], names=["vec", keep, "cell", "far"])

    kind = rows.schema[keep].dataType.simpleString()
    return rows.select("vec", keep).mapInArrow(near, f"vec binary, {keep} {kind}, cell int, far double")


def _plan(pivots: np.ndarray, data: list, groups: list, k: int, room: float) -> list[tuple]:
    """(group, cell, low, high, data blocks, query blocks) of all pairs that are needed."""
    apart = np.sqrt(np.maximum(0, ((pivots[:, None] - pivots[None]) ** 2).sum(-1)))
    out = []
    for g in groups:
        near = []
        for d in data:
            near += [(g["radius"] + apart[g["cell"], d["cell"]] + x) for x in d["least"]]
        near.sort()
        reach = near[k - 1] if len(near) >= k else float("inf")
        reach = reach * (1 + 8 * EPS) + 3 * room
        for d in data:
            gap = apart[g["cell"], d["cell"]]
            low, high = gap - g["radius"] - reach, gap + g["radius"] + reach
            low, high = float(low - 3 * room - 8 * EPS * abs(low)), float(high + 3 * room + 8 * EPS * abs(high))
            if low <= d["far"] and high >= d["near"]:
                out.append((g["cell"], d["cell"], low, high, -(-d["n"] // BLOCK), -(-g["n"] // BLOCK)))
    return out


def topk_join(rows: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, id, score) from (id, vec) with whole-number vectors."""
    return by_length(rows.where("id is not null"), lambda part: _among(part, is_query, k))


def _among(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``topk_join`` of vectors of one length."""
    spark = rows.sparkSession
    data = cut(distinct_vectors(rows, k + 1), "vectors")
    asked = cut(rows.where(is_query).select("id", "vec").distinct().withColumn("vkey", F.xxhash64("vec")), "asked")
    queries = asked.select("vec", "vkey").distinct()
    n_queries = queries.count()
    most = data.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0] or 0.0
    sample = data.select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).toArrow()["vec"].combine_chunks()
    sample = lifted(matrix(sample, np.float64), most, False) if len(sample) else np.zeros((0, 1))
    pivots = pivots_of(sample, max(4, min(MOST_PIVOTS, n_queries // 128)))

    d = cut(_assign(data, pivots, most, False, "ids"), "cells")
    q = cut(_assign(queries, pivots, most, True, "vkey"), "groups")
    # the k + 1 smallest distances of each cell; ids of one vector count up to k + 1
    order = W.partitionBy("cell").orderBy("far")
    least = d.select("cell", "far", F.explode("ids")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    least = {r["cell"]: sorted(r["least"]) for r in least.groupBy("cell").agg(F.collect_list("far").alias("least")).collect()}
    cells = [r.asDict() | {"least": least[r["cell"]]} for r in d.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).collect()]
    groups = [r.asDict() for r in q.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()]
    plan = spark.createDataFrame(_plan(pivots, cells, groups, k + 1, slack(pivots, most)), "g int, cell int, low double, high double, nd int, nq int")

    near = d.withColumnRenamed("cell", "c").join(F.broadcast(plan), (F.col("c") == F.col("cell")) & F.col("far").between(F.col("low"), F.col("high")))
    near = near.withColumn("b", F.pmod(F.xxhash64("vec"), F.col("nd")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    near = near.select("g", "cell", "a", "b", "vec", "ids")
    ask = q.withColumnRenamed("cell", "c").join(F.broadcast(plan), F.col("c") == F.col("g"))
    ask = ask.withColumn("a", F.pmod("vkey", F.col("nq")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nd") - 1)))
    ask = ask.select(F.col("g").alias("qg"), F.col("cell").alias("qcell"), F.col("a").alias("qa"), F.col("b").alias("qb"), "vec", "vkey")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["vkey", "id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
        x = unpacked(right["vec"], np.int64)
        counts = right["ids"].map(len).to_numpy()
        ids, of = np.concatenate(right["ids"].to_numpy()).astype(np.int64), np.repeat(np.arange(len(x)), counts)
        first = np.array([v[0] for v in right["ids"]], np.int64)
        by_id = np.argsort(first, kind="stable")
        parts = []
        for at in range(0, len(left), 256):
            part = left.iloc[at : at + 256]
            score = products(unpacked(part["vec"], np.int64), x)
            for vkey, s in zip(part["vkey"].to_numpy(), score, strict=True):
                if len(s) > k + 1:  # no vector below the (k + 1)-th score can matter
                    edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                    best = by_id[s[by_id] >= edge]
                    best = best[np.argsort(-s[best], kind="stable")][: k + 1]
                else:
                    best = np.arange(len(s))
                mine = np.isin(of, best)
                i, v = ids[mine], s[of[mine]]
                top = np.lexsort((i, -v))[: k + 1]
                parts.append((np.full(len(top), vkey), i[top], v[top]))
        return pd.DataFrame({n: np.concatenate([p[j] for p in parts]) for j, n in enumerate(names)})

    local = ask.groupBy("qg", "qcell", "qa", "qb").cogroup(near.groupBy("g", "cell", "a", "b")).applyInPandas(solve, "vkey long, id long, score long")
    best = W.partitionBy("vkey").orderBy(F.desc("score"), F.asc("id"))
    top = local.distinct().withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).select("vkey", "id", "score")
    out = asked.select(F.col("id").alias("query_id"), "vkey").join(top, "vkey").where("id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))
    return out.select("query_id", rank.cast("int").alias("rank"), "id", "score").where(F.col("rank") <= k)


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The five largest whole inner products of every fiftieth vector with all others."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    rows = rows.where(finite(F.col("v")))
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    found = topk_join(rows.select("id", whole.alias("vec")), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(list_transform(q.e, lambda x: CAST(x AS DOUBLE)), list_transform(d.e, lambda x: CAST(x AS DOUBLE))) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
