"""Approximate nearest neighbours in a hash-prefix forest.

Every tree gives a vector a hash string of ``BITS`` bits, the sides of random
hyperplanes on which it lies, and keeps its strings sorted.  A query descends in
every tree to its longest matching prefixes and then ascends in all trees at the
same pace: at each level it takes all strings that share that many bits with its
own, until all trees together have given ``budget`` candidates or the floor level
is reached.  The floor is only the first stop: a query that has met too few ids
there, or none, goes on ascending until one tree alone holds enough of them and all
trees have given the budget, at last to level 0, where everything is met.
Candidates are scored exactly by inner product in double precision.

Largest inner product is turned into smallest angle by one more component,
``sqrt(M - |x|^2)``, with M the largest squared norm.

*Floor and budget are measured.*  A bounded sample of query vectors (``PROBES``)
is held against every indexed vector; the floor is the deepest level at which
the union over all trees still finds ``target`` of the true neighbours, and the
budget the mean number of strings met down to it.  On clustered vectors that is
a small share of the table; on vectors without structure no hash helps, and the
floor comes up until recall holds.

A tree's sorted strings are laid out by floor prefix, in blocks of a fixed number
of vectors, and one that many queries have in blocks of queries; a query meets exactly
the blocks of its own prefix.  Below the floor
only the prefixes that such queries ask for are laid out again, in blocks of vectors
and of queries.  Equal vectors are indexed once, with their smallest ids.

Edge cases: vectors that are null, empty, zero or non-finite take no part, nor do null
ids.  Vectors of several lengths are searched length by length, as they have no inner
product with others.  Rows equal in id and vector count once.  Ties go to the smaller id.  With
fewer candidates than k, all are returned; an empty table gives an empty result.  Other
columns of the table are not read.
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

K = 20
TREES = 24
BITS = 32
BLOCK = 4096
PROBES = 64
TARGET = 0.94
SEED = 5


def planes(dim: int, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    """Hyperplane normals, one column for each bit of each tree."""
    return np.random.default_rng(seed).normal(size=(dim, trees * BITS))


def codes(wide: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Hash strings (rows by trees), first bit highest."""
    bits = (wide @ normals > 0).reshape(len(wide), -1, BITS)
    return (bits * (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))).sum(axis=2, dtype=np.uint64).astype(np.uint32)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of hash strings."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def widened(x: np.ndarray, most: float, query: bool) -> np.ndarray:
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))
    return np.concatenate([x, last[:, None]], axis=1)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query, summed in component order."""
    out = np.zeros(len(x))
    for k in range(len(q)):
        out += q[k] * x[:, k]
    return out


def level_ranges(sorted_codes: np.ndarray, code: np.uint32, level: int) -> tuple[int, int]:
    """Where the strings that share ``level`` bits with ``code`` lie."""
    if level == 0:
        return 0, len(sorted_codes)
    low = (int(code) >> (BITS - level)) << (BITS - level)
    high = low + (1 << (BITS - level)) - 1
    return int(np.searchsorted(sorted_codes, np.uint32(low))), int(np.searchsorted(sorted_codes, np.uint32(high), "right"))


def floor_and_budget(data: DataFrame, queries: DataFrame, normals: np.ndarray, most: float, k: int, target: float) -> tuple[int, int]:
    """The deepest level that reaches the target recall on a sample, and its mean count."""
    probes = queries.select("vec").orderBy(F.xxhash64("vec")).limit(PROBES).toArrow()["vec"].combine_chunks()
    if not len(probes):
        return 0, 0
    q = matrix(probes)
    spread = data.sparkSession.sparkContext.broadcast((q, codes(widened(q, most, True), normals), normals))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own, normals = spread.value
        for batch in chunks(batches, BLOCK):
            x = matrix(batch.column(0))
            theirs = codes(widened(x, most, False), normals)
            score = q @ x.T
            same = np.isclose(score, (q * q).sum(1)[:, None]) & np.isclose((x * x).sum(1)[None], (q * q).sum(1)[:, None])
            top = np.argsort(-np.where(same, -np.inf, score), axis=1)[:, :k]
            for i in range(len(q)):
                met = common(theirs, own[i])
                counts = np.bincount(met.reshape(-1), minlength=BITS + 1)
                j = top[i]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i, np.int32)), pa.array(np.where(same[i, j], -np.inf, score[i, j])), pa.array(met[j].max(axis=1).astype(np.int32)), pa.array([counts.tolist() if n == 0 else None for n in range(len(j))], pa.list_(pa.int64()))], names=["probe", "score", "level", "counts"])

    found = cut(data.select("vec").mapInArrow(near, "probe int, score double, level int, counts array<long>"), "probes")
    best = F.row_number().over(W.partitionBy("probe").orderBy(F.desc("score")))
    levels = np.array([r["level"] for r in found.where("score > double('-inf')").withColumn("nth", best).where(F.col("nth") <= k).collect()], np.int64)
    sums = found.where("counts is not null").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    at_least = np.zeros(BITS + 2)
    for r in sums:
        at_least[: r["pos"] + 1] += r["n"]
    for level in range(BITS, -1, -1):
        if not len(levels) or (levels >= level).mean() >= target:
            return level, int(at_least[level] / len(q))
    return 0, int(at_least[0] / len(q))


def _laid_out(rows: DataFrame, normals: np.ndarray, most: float, query: bool, floor: int, keep: str) -> DataFrame:
    """(tree, prefix, code, vec, keep): every row once in each tree."""
    spread = rows.sparkSession.sparkContext.broadcast(normals)
    trees = normals.shape[1] // BITS

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1024):
            x = matrix(batch.column(0))
            code = codes(widened(x, most, query), spread.value)
            blobs = packed(x.astype(np.float64))
            for t in range(trees):
                prefix = code[:, t].astype(np.int64) >> (BITS - floor) if floor else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(prefix), pa.array(code[:, t].astype(np.int64)), blobs, batch.column(1)], names=["tree", "prefix", "code", "vec", keep])

    kind = rows.schema[keep].dataType.simpleString()
    return rows.select("vec", keep).mapInArrow(lay, f"tree int, prefix long, code long, vec binary, {keep} {kind}")


def _below_floor(ask: DataFrame, sizes: DataFrame, floor: int, budget: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Where queries that lack candidates go on: (their rows by cell, the cells of each stored prefix).

    A cell is a prefix shorter than the floor, its block of vectors and of queries.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(floor - 1))).alias("at")
    upper = F.expr(f"shiftright(prefix, {floor} - at)").alias("upper")
    stored = sizes.select("tree", "prefix", "n", "n_ids", levels).select("*", upper)
    above = stored.groupBy("tree", "at", "upper").agg(F.sum("n").alias("n"), F.sum("n_ids").alias("n_ids"))
    met = ask.select("vkey", "tree", "prefix", levels).select("vkey", "tree", "at", upper).join(above, ["tree", "at", "upper"])
    met = met.groupBy("vkey", "at").agg(F.max("n_ids").alias("surely"), F.sum("n").alias("n"))
    stop = met.groupBy("vkey").agg(F.coalesce(F.max(F.when((F.col("surely") > k) & (F.col("n") >= budget), F.col("at"))), F.lit(0)).alias("at"))
    wide = cut(ask.join(stop, "vkey").where("at > 0 or tree = 0").select("*", upper).drop("prefix"), "wide")  # one tree has all vectors
    cells = wide.groupBy("tree", "at", "upper").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nq")).join(above, ["tree", "at", "upper"])
    cells = cut(cells.select("tree", "at", "upper", "nq", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb")), "cells")
    left = wide.join(cells, ["tree", "at", "upper"]).withColumn("part", F.pmod(F.xxhash64("vkey"), F.col("nq")).cast("int"))
    left = left.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nq", "nb")
    return left, stored.select("tree", "prefix", "at", "upper").join(cells, ["tree", "at", "upper"])


def search(rows: DataFrame, is_query: Column, k: int = K, trees: int = TREES, target: float = TARGET) -> DataFrame:
    """(query_id, rank, id, score) from (id, vec)."""
    rows = rows.where(F.col("id").isNotNull() & F.exists("vec", lambda x: x != 0))
    return by_length(rows, lambda part: _among(part, is_query, k, trees, target))


def _among(rows: DataFrame, is_query: Column, k: int, trees: int, target: float) -> DataFrame:
    """``search`` of vectors of one length."""
    data = cut(distinct_vectors(rows, k + 1), "vectors")
    asked = cut(rows.where(is_query).select("id", "vec").distinct().withColumn("vkey", F.xxhash64("vec")), "asked")
    queries = asked.select("vec", "vkey").distinct()
    most, dim = data.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.max(F.size("vec"))).first()
    most, normals = most or 0.0, planes((dim or 0) + 1, trees)
    floor, budget = floor_and_budget(data, queries, normals, most, k, target)

    index = cut(_laid_out(data, normals, most, False, floor, "ids"), "index")
    # a prefix with many strings is cut in blocks
    sizes = cut(index.groupBy("tree", "prefix").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"), F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("n_ids")), "sizes")
    every, asking = index, cut(_laid_out(queries, normals, most, True, floor, "vkey"), "ask")
    blocks = asking.groupBy("tree", "prefix").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nq")).join(sizes.select("tree", "prefix", "nb"), ["tree", "prefix"])
    # as is one with many queries: each task meets a block of both
    index = index.join(blocks, ["tree", "prefix"]).withColumn("b", F.pmod(F.xxhash64("vec"), F.col("nb")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    ask = asking.join(blocks, ["tree", "prefix"]).withColumn("part", F.pmod(F.xxhash64("vkey"), F.col("nq")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))

    # ascend: how many strings share at least each number of bits, in all trees
    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(right["code"].to_numpy().astype(np.uint32))
        out = []
        for vkey, code in zip(left["vkey"], left["code"], strict=True):
            got = [b - a for a, b in (level_ranges(own, np.uint32(code), x) for x in range(floor, BITS + 1))] if len(own) else [0] * (BITS + 1 - floor)
            out.append((vkey, got))
        return pd.DataFrame(out, columns=["vkey", "met"])

    key = ["tree", "prefix", "b", "part"]
    q_key = [F.col(c).alias(f"q_{c}") for c in key]
    q_names = [f"q_{c}" for c in key]
    met = ask.select(*q_key, "code", "vkey").groupBy(*q_names).cogroup(index.select(*key, "code").groupBy(*key)).applyInPandas(count, "vkey long, met array<long>")
    total = met.select("vkey", F.posexplode("met")).groupBy("vkey", "pos").agg(F.sum("col").alias("n"))
    level = total.groupBy("vkey").agg(F.max(F.when(F.col("n") >= budget, F.col("pos") + floor)).alias("at"))
    level = cut(level.select("vkey", F.coalesce("at", F.lit(floor)).cast("int").alias("at")), "level")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            order = np.argsort(right["code"].to_numpy(), kind="stable")
            own, x, ids = right["code"].to_numpy()[order].astype(np.uint32), unpacked(right["vec"])[order], right["ids"].to_numpy()[order]
            for vkey, code, at, q in zip(left["vkey"], left["code"], left["at"], unpacked(left["vec"]), strict=True):
                a, b = level_ranges(own, np.uint32(code), int(at))
                if a == b:
                    continue
                rough = x[a:b] @ q
                top = np.arange(b - a)
                if len(top) > k + 1:  # leave room for rounding, then sum in order
                    edge = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
                    top = np.flatnonzero(rough >= edge - 1e-9 * (1 + abs(edge)))
                score = exact_scores(q, x[a:b][top])
                i = np.concatenate(ids[a:b][top]).astype(np.int64)
                v = np.repeat(score, [len(z) for z in ids[a:b][top]])
                best = np.lexsort((i, -v))[: k + 1]
                parts.append(pd.DataFrame({"vkey": vkey, "id": i[best], "score": v[best]}))
        return pd.concat(parts) if parts else pd.DataFrame({"vkey": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})

    leveled = ask.select(*q_key, "code", "vec", "vkey").join(level, "vkey")
    local = leveled.groupBy(*q_names).cogroup(index.select(*key, "code", "vec", "ids").groupBy(*key)).applyInPandas(solve, "vkey long, id long, score double")
    best = W.partitionBy("vkey").orderBy(F.desc("score"), F.asc("id"))

    def first(local: DataFrame) -> DataFrame:
        return local.groupBy("vkey", "id").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).select("vkey", "id", "score")

    top = first(local)
    if floor:
        top = cut(top, "top")
        served = top.groupBy("vkey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
        short = cut(queries.join(served, "vkey", "left_anti").select("vkey"), "short")
        if not short.isEmpty():
            left, cells = _below_floor(asking.join(short, "vkey", "left_semi"), sizes, floor, budget, k)
            right = every.join(cells, ["tree", "prefix"]).withColumn("b", F.pmod(F.xxhash64("vec"), F.col("nb")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
            key = ["tree", "at", "upper", "b", "part"]
            left = left.select(*[F.col(c).alias(f"q_{c}") for c in key], "at", "code", "vec", "vkey")
            more = left.groupBy(*[f"q_{c}" for c in key]).cogroup(right.select(*key, "code", "vec", "ids").groupBy(*key)).applyInPandas(solve, "vkey long, id long, score double")
            top = first(top.unionByName(more))
    out = asked.select(F.col("id").alias("query_id"), "vkey").join(top, "vkey").where("id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))
    return out.select("query_id", rank.cast("int").alias("rank"), "id", "score").where(F.col("rank") <= k)


def op5_ann_forest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every twentieth vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    found = search(rows.where(finite(F.col("vec"))), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
