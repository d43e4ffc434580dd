"""Candidate pairs from lists of sets that share a key, without all pairs of a group.

A list holds the sets that share one key (a prefix shingle).  Rows are (list, at, sid):
``at`` packs the set's size, the key's position in it and a side, in this order.  Short
lists give all pairs that the size and position bounds leave.  Long lists are worked
through in rounds: first all sets against a few leaders, then only pairs of sets whose
components still differ, with a bitmap bound checked before a pair leaves its task.

Lists too long for one task meet one leader first, as they are.  What then still lies in
other components than the leader's is dealt out: in cells of two blocks each, where
blocks of the leader's component never meet each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, merged
from ..operators.skew import spread_join
from . import hashing
from .scratch import cut, drop

LIST_BLOCK = 4096
SHORT_LIST = 24
LEADERS = 12
WORDS = 16  # of 64 bits in a set's bitmap
RUN_ROWS, RUN_BYTES = 20_000, 8_000_000  # of lists that are worked through at a time
CLOSE = 0.2  # of the bits of two sets: so near, one's distances tell the other's


def packed_at(size: Column, pos: Column, side: Column) -> Column:
    return (F.shiftleft(size.cast("long"), 32) + pos * 4 + side).cast("long")


def dealt(rows: DataFrame, comp: DataFrame, hot: DataFrame | None, block: int, keep: list[str]) -> DataFrame:
    """(list, side, sid, comp, keep..): very long lists (key, sid, keep..) as cells of two blocks.

    The component of a list's smallest set fills blocks of its own, which never meet each
    other; so a list that this leader has settled but for a few rows is copied only for
    those few.  Side 2: a block meets itself; else 0 and 1 meet each other.
    """
    rows = rows.join(comp.select(F.col("node").alias("sid"), F.col("component").alias("comp")), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    lead = rows.groupBy("key").agg(F.min_by("comp", "sid").alias("lead"))
    rows = spread_join(rows, lead, "key", hot, ["sid"]).withColumn("main", F.col("comp") == F.col("lead"))
    count = lambda c: F.ceil(F.count(F.when(c, 1)) / block).cast("int")
    blocks = rows.groupBy("key").agg(count(F.col("main")).alias("p"), count(~F.col("main")).alias("q")).where("q > 0")
    rows = spread_join(rows, blocks, "key", hot, ["sid"])
    hashed = F.xxhash64("sid")
    rows = rows.withColumn("mine", F.when(F.col("main"), F.pmod(hashed, F.col("p"))).otherwise(F.col("p") + F.pmod(hashed, F.col("q"))).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.when(F.col("main"), F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1)))
    side = F.when(F.col("mine") == F.col("with"), 2).when(F.col("mine") < F.col("with"), 0).otherwise(1)
    return rows.select(F.xxhash64("key", F.least("mine", "with"), F.greatest("mine", "with")).alias("list"), side.alias("side"), "sid", "comp", *keep)


def split_lists(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (sid, other) of short lists, and the rows of long ones (other is null)."""
    in_order = rows.repartition("list").sortWithinPartitions("list", "at", "sid")
    return cut(in_order.mapInArrow(_split(percent), "list long, at long, sid long, other long"), "lists")


def needed_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of two linked sets whose sizes add up to ``total``."""
    return -((-percent * total) // (100 + percent))


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Column arrays of whole lists, and the lists' bounds; rows come sorted by list.

    Short batches are put together, up to ``RUN_ROWS`` rows or ``RUN_BYTES`` bytes.
    """
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < RUN_ROWS and size < RUN_BYTES:
            continue
        keys = batch.column(0).to_numpy()
        starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if not len(starts):
            if len(held) == 1 or held[-2].column(0)[-1].as_py() == keys[0]:
                continue  # the last list goes on
            starts = np.zeros(1, np.int64)
        at = int(starts[-1])
        yield from _cut_lists([*held[:-1], batch.slice(0, at)])
        held = [batch.slice(at)]
        rows, size = held[0].num_rows, held[0].nbytes
    yield from _cut_lists(held)


def _cut_lists(batches: list[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    if batches and (whole := pa.Table.from_batches(batches)).num_rows:
        cols = {c: whole[c].to_numpy() for c in whole.column_names}
        keys = cols["list"]
        yield cols, np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def _fits(size_a, pos_a, size_b, pos_b, percent: int) -> np.ndarray:
    """Whether two sets that meet at these positions can still reach the overlap of a link."""
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    reach = 1 + np.minimum(size_a - pos_a - 1, size_b - pos_b - 1)
    return (100 * low >= percent * high) & (reach >= needed_overlap(size_a + size_b, percent))


def met(side_a, side_b) -> np.ndarray:
    """Whether two rows of a cell are to be compared there (see ``side``)."""
    return (side_a != side_b) | (side_a == 2)


def _split(percent: int):
    """Pairs (sid, other) of short lists; the rows of long lists (other is null)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, _ in whole_lists(batches):
            key, at, sid = cols["list"], cols["at"], cols["sid"]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
            key, at, sid = key[new], at[new], sid[new]
            bounds = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            length = np.repeat(np.diff(bounds), np.diff(bounds))
            short = (length > 1) & (length <= SHORT_LIST)
            size, pos = at >> 32, (at >> 2) & 0x3FFFFFFF
            found = [np.zeros((0, 2), np.int64)]
            for d in range(1, SHORT_LIST):
                i = np.flatnonzero(short[d:] & (key[d:] == key[:-d]))
                if not len(i):
                    break
                j = i + d
                ok = _fits(size[i], pos[i], size[j], pos[j], percent)
                x, y = sid[i[ok]], sid[j[ok]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["list", "at", "sid", "other"])
            more = length > SHORT_LIST
            if more.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[more]), pa.array(at[more]), pa.array(sid[more]), pa.nulls(int(more.sum()), pa.int64())], names=["list", "at", "sid", "other"])

    return split


class _List:
    """A list's rows by (size, position), with the index that skips blocks of it.

    Sizes form blocks in which positions rise.  For a given set, a block is used up to
    the last position from which the overlap of a link can still be reached, and sizes
    beyond the ratio are not touched.  Bitmap distances of the last *pivot* are kept: of
    a set close to it, only those rows can be answers whose distance to the pivot, less
    the set's own, is small enough (distances obey the triangle inequality); the others
    are left out without being looked at.
    """

    def __init__(self, cols: dict[str, np.ndarray], s: int, e: int, percent: int):
        self.sid, self.comp, self.at, self.percent = cols["sid"][s:e], cols["comp"][s:e], cols["at"][s:e], percent
        self.size, self.pos, self.side = self.at >> 32, (self.at >> 2) & 0x3FFFFFFF, self.at & 3
        self.bits = np.frombuffer(b"".join(cols["marks"][s:e]), np.uint64).reshape(-1, WORDS)
        self.start = np.r_[0, np.flatnonzero(self.size[1:] != self.size[:-1]) + 1]
        self.sizes = self.size[self.start]
        self.pivot, self.far = -1, np.zeros(0, np.int64)

    def distance(self, h: int, j: np.ndarray | slice) -> np.ndarray:
        return np.bitwise_count(self.bits[j] ^ self.bits[h]).sum(axis=1, dtype=np.int64)

    def reachable(self, h: int, after: int) -> np.ndarray:
        """Rows from ``after`` on that sizes and positions leave for row ``h``."""
        a = np.searchsorted(self.sizes, -(-self.size[h] * self.percent // 100))
        b = np.searchsorted(self.sizes, self.size[h] * 100 // self.percent, "right")
        sizes, start = self.sizes[a:b], self.start[a:b]
        need = needed_overlap(self.size[h] + sizes, self.percent)
        useful = np.minimum(sizes - need, np.where(self.size[h] - self.pos[h] >= need, sizes, -1))
        end = np.searchsorted(self.at, (sizes << 32) + (np.maximum(useful + 1, 0) << 2))
        start = np.maximum(start, after)
        n = np.maximum(end - start, 0)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)

    def likely(self, h: int, after: int) -> np.ndarray:
        """Rows of other components that bitmaps do not exclude for row ``h``."""
        j = self.reachable(h, after)
        j = j[(self.comp[j] != self.comp[h]) & met(self.side[j], self.side[h])]
        if not len(j):
            return j
        total = self.size[h] + self.size[j]
        limit = total - 2 * needed_overlap(total, self.percent)
        if self.pivot < 0 or self.far[h] > CLOSE * self.size[h]:
            self.pivot, self.far = h, self.distance(h, slice(None))
            return j[self.far[j] <= limit]
        near = self.far[j] - self.far[h] <= limit
        j, limit = j[near], limit[near]
        return j[self.distance(h, j) <= limit]


def long_pairs(lists: DataFrame, percent: int, last: bool, seed: int) -> DataFrame:
    """Pairs (a, b) of sets in long lists that lie in different components.

    All sets are paired with a few leaders, or in the last round with all others; the
    bitmaps are compared here already, so only likely pairs leave the task.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, bounds in whole_lists(batches):
            found = [np.zeros((0, 2), np.int64)]
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if (cols["comp"][s:e] == cols["comp"][s]).all():
                    continue
                rows = _List(cols, s, e, percent)
                heads = np.arange(e - s) if last else np.argsort(hashing.mix(rows.sid.view(np.uint64) + np.uint64(seed)), kind="stable")[:LEADERS]
                for h in heads:
                    j = rows.likely(h, h + 1 if last else 0)
                    if len(j):
                        first, other = np.full(len(j), rows.sid[h]), rows.sid[j]
                        turn = last & (rows.size[j] == rows.size[h]) & (other < first)  # one order for equal sizes
                        found.append(np.stack([np.where(turn, other, first), np.where(turn, first, other)], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    rows = lists.repartition("list").sortWithinPartitions("list", "at", "sid").select("list", "at", "sid", "comp", "marks")
    return rows.mapInArrow(emit, "a long, b long")


def settled(pairs: DataFrame, long: DataFrame, percent: int, verify: Callable[[DataFrame], DataFrame], deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """(node, component) of all sets that link; ``long`` has list, at, sid, marks.

    ``verify`` keeps the pairs (a, b) that link.  ``deal`` gives more rows (list, at, sid,
    comp, marks) for the last round, from the components known by then.  None if there
    are no links.
    """
    comp = None
    for last in (False, True):
        now = long.withColumn("comp", F.col("sid"))
        if comp is not None:
            now = long.join(comp.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")
        if last and deal is not None:
            known = comp if comp is not None else pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
            now = now.select("list", "at", "sid", "comp", "marks").unionByName(deal(known))
        elif last and long.isEmpty():
            break
        more = long_pairs(now, percent, last, 2 if last else 1)
        todo = cut((more if last else more.unionByName(pairs)).distinct(), "pairs")
        if not todo.isEmpty():
            found = cut(verify(todo), "links")
            comp = components(found) if comp is None else merged(comp, found)
            drop(found)
        drop(todo)
    return comp
