"""Bounded summaries that a whole cluster can share: token loads and id filters."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


class TokenLoads:
    """How many occurrences fell into each of 2**bits hash buckets, over all rows.

    The load of a token's bucket is never below its own count.  Loads are kept
    as eighths of a binary logarithm, one byte a bucket.
    """

    def __init__(self, levels: np.ndarray):
        self.levels = levels
        self.shift = np.uint64(64 - (len(levels).bit_length() - 1))
        self.typical = float(np.expm1(np.mean(levels, dtype=np.float64) / 8 * np.log(2))) if len(levels) else 0.0

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Loads (to within a ninth) of tokens."""
        return np.expm1(self.levels[(tokens >> self.shift).astype(np.int64)] / 8.0 * np.log(2))


def token_loads(df: DataFrame, columns: list[str], tokens_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = 22) -> TokenLoads:
    """Sum every task's bucket counts; 2**bits bytes reach the driver at any scale."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(1 << bits, np.uint32)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for tokens in tokens_of(batch):
                held.append((tokens >> np.uint64(64 - bits)).astype(np.uint32))
                size += len(tokens)
                if size >= 1 << 20:
                    np.add.at(loads, np.concatenate(held), np.uint32(1))
                    held, size = [], 0
        if held:
            np.add.at(loads, np.concatenate(held), np.uint32(1))
        if not loads.any():
            return
        small = loads.astype(np.uint8) if loads.max() < 256 else loads
        blocks = small.reshape(-1, BLOCK)
        ids = np.flatnonzero(blocks.any(axis=1))
        packed = [zlib.compress(blocks[i].tobytes(), 1) for i in ids]
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(np.full(len(ids), small.itemsize, np.int32)), pa.array(packed, pa.binary())], names=["block", "width", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.uint64)
        for width, counts in zip(pdf["width"], pdf["counts"], strict=True):
            total += np.frombuffer(zlib.decompress(counts), np.uint8 if width == 1 else np.uint32)
        level = np.minimum(255, np.rint(8 * np.log2(1 + total.astype(np.float64)))).astype(np.uint8)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "level": [level.tobytes()]})

    parts = df.select(*columns).mapInArrow(count, "block int, width int, counts binary")
    rows = parts.groupBy("block").applyInPandas(add, "block int, level binary").collect()
    levels = np.zeros(1 << bits, np.uint8)
    for r in rows:
        levels[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["level"], np.uint8)
    return TokenLoads(levels)


class IdFilter:
    """A bit table that holds every given id; others pass with a small chance."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.bits = np.uint64(len(words) * 64 - 1)

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        at = _spread(ids.astype(np.int64)) & self.bits
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _spread(ids: np.ndarray) -> np.ndarray:
    h = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def id_filter(df: DataFrame, col: str, most_bits: int = 27) -> IdFilter:
    """A filter of 16 to 32 bits a row of ``df``, at most 2**27 (16 MB).

    At most 2**(bits - 6) rows reach the driver.  Beyond the bound the filter lets more
    rows pass, which the join behind it then drops.
    """
    bits = min(most_bits, max(16, (16 * df.count()).bit_length()))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            at = _spread(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)) & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        held = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(words[held].view(np.int64))], names=["at", "word"])

    rows = df.select(F.col(col).cast("long").alias(col)).where(F.col(col).isNotNull()).mapInArrow(put, "at int, word long")
    got = rows.groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got["at"].to_numpy()] = got["word"].to_numpy().view(np.uint64)
    return IdFilter(words)


def differing_bits(a: Column, b: Column) -> Column:
    """How many bits two arrays of longs differ in."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def vector_sum(df: DataFrame, rows: int, size: int, tally: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """The sum over all tasks of a rows x size table of counts that ``tally`` adds to.

    Only those rows * size numbers reach the driver, at any scale.
    """
    block = min(size, BLOCK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, size), np.int64)
        for batch in batches:
            tally(batch, total)
        flat = total.reshape(-1, block)
        ids = np.flatnonzero(flat.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array([zlib.compress(flat[i].tobytes(), 1) for i in ids], pa.binary())], names=["block", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in pdf["counts"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [total.tobytes()]})

    out = np.zeros((rows * size // block, block), np.int64)
    for r in df.mapInArrow(count, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        out[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(rows, size)
