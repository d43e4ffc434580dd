"""Best-fit packing of token sequences into bins, under conflicts.

A document of n tokens is cut into pieces of ``capacity`` tokens; full pieces
fill a bin each, and the last, shorter piece is packed.  Pieces go in by falling
length.  A piece may enter a bin that has room for it, holds no piece of the same
duplicate cluster, and holds fewer than ``per_source`` pieces of its source.  Of
those it takes the tightest.

Bins are ordered by residual room in a tree over the residuals.  Every bin
carries a bitmap of the sources it is full of and of the clusters it holds, and
every node the bits that all bins below it share.  The search starts at the
first residual that is large enough and moves to the next one until it finds a
compatible bin; a node whose shared bits conflict is passed over whole.

Documents are dealt out by a hash to shards of about ``SHARD`` rows, which are
packed side by side, so neither a hot source nor a hot cluster gathers in one
task; a bin never crosses shards, which leaves at most a few half-filled bins a
shard.  Only ids, lengths, sources and cluster digests move, never texts.

Edge cases: texts are measured whole; very long ones fill many bins of their own.  Other
columns are left out.  A null cluster is no cluster: it conflicts with nothing.  An empty
table gives an empty result.  A document without tokens (or null text) gets one row without a bin.
Repeated rows are told apart by a copy number and share their cluster, so they
land in different bins.  A null source is a source of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import n_words
from .scratch import cut, table

CAPACITY = 2048
PER_SOURCE = 2
SHARD = 8192
PLACED = "doc_id long, copy int, piece long, start long, stop long, bin string"


class Bins:
    """Open bins by residual room; leaves of a tree of shared conflict bits."""

    def __init__(self, capacity: int, bits: int):
        self.size = 1 << capacity.bit_length()
        self.none = (1 << bits) - 1  # the bits shared by no bins: all
        self.shared = [self.none] * (2 * self.size)
        self.at: list[dict[int, int]] = [{} for _ in range(self.size)]  # residual: bin -> bits
        self.empty = [True] * (2 * self.size)

    def _refresh(self, r: int) -> None:
        node = r + self.size
        value = self.none
        for bits in self.at[r].values():
            value &= bits
        self.shared[node], self.empty[node] = value, not self.at[r]
        node >>= 1
        while node:
            value, empty = self.shared[2 * node] & self.shared[2 * node + 1], self.empty[2 * node] and self.empty[2 * node + 1]
            if self.shared[node] == value and self.empty[node] == empty:
                break
            self.shared[node], self.empty[node] = value, empty
            node >>= 1

    def put(self, r: int, k: int, bits: int) -> None:
        self.at[r][k] = bits
        self._refresh(r)

    def take(self, r: int, k: int) -> int:
        bits = self.at[r].pop(k)
        self._refresh(r)
        return bits

    def _next(self, r: int, conflict: int) -> int:
        """The first residual from r on that may have a bin without the conflict bits."""
        node = r + self.size
        while True:
            if not self.empty[node] and not self.shared[node] & conflict:
                while node < self.size:
                    left = 2 * node
                    node = left if not self.empty[left] and not self.shared[left] & conflict else left + 1
                    if self.empty[node] or self.shared[node] & conflict:
                        break
                else:
                    return node - self.size
            while node & 1:
                node >>= 1
            if not node:
                return -1
            node += 1
            if node & (node - 1) == 0:
                return -1

    def best(self, need: int, conflict: int) -> tuple[int, int]:
        """(residual, bin) of the tightest compatible bin, or (-1, -1)."""
        r = need
        while r < self.size and (r := self._next(r, conflict)) >= 0:
            for k, bits in self.at[r].items():
                if not bits & conflict:
                    return r, k
            r += 1
        return -1, -1


def pack(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int, per_source: int) -> np.ndarray:
    """The bin of each piece; pieces come by falling length."""
    n_sources = int(sources.max()) + 1 if len(sources) else 0
    _, cluster, copies = np.unique(clusters, return_inverse=True, return_counts=True)
    shared = np.cumsum(copies > 1) - 1  # only clusters with copies here need a bit
    bins = Bins(capacity, n_sources + int((copies > 1).sum()))
    held: list[dict[int, int]] = []
    out = np.zeros(len(lengths), np.int64)
    for i, (need, s, c) in enumerate(zip(lengths.tolist(), sources.tolist(), cluster.tolist(), strict=True)):
        own = 1 << (n_sources + int(shared[c])) if copies[c] > 1 else 0
        r, k = bins.best(need, 1 << s | own)
        if k < 0:
            r, k, bits = capacity, len(held), 0
            held.append({})
        else:
            bits = bins.take(r, k)
        held[k][s] = held[k].get(s, 0) + 1
        bits |= own | (1 << s if held[k][s] >= per_source else 0)
        if r > need:
            bins.put(r - need, k, bits)
        out[i] = k
    return out


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    length_col: str = "n_tokens",
    cluster_col: str = "cluster",
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    shard: int = SHARD,
) -> DataFrame:
    """(doc_id, copy, piece, start, stop, bin): the pieces of every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("n"), F.col(cluster_col).cast("long").alias("cluster"))
    rows = cut(rows.groupBy("doc_id", "source", "n", "cluster").agg(F.count(F.lit(1)).alias("copies")), "pieces")
    total = rows.agg(F.sum("copies").alias("c")).first()["c"] or 0
    shards = max(1, -(-total // shard))
    one = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    one = one.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(shards)))

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "copy", "cluster", "n"], kind="stable").reset_index(drop=True)
        n = pdf["n"].to_numpy()
        full, rest = n // capacity, n % capacity
        name = f"{key[0]}-"
        # full pieces
        who = np.repeat(np.arange(len(pdf)), full)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(full) - full, full)
        parts = [pd.DataFrame({"row": who, "piece": nth, "start": nth * capacity, "stop": (nth + 1) * capacity, "bin": [f"{name}f{k}" for k in range(len(who))]})]
        # last pieces
        last = np.flatnonzero(rest)
        last = last[np.argsort(-rest[last], kind="stable")]
        source = pd.factorize(pdf["source"].fillna("\0null").to_numpy()[last])[0] if len(last) else np.zeros(0, np.int64)
        # pieces without a cluster get a number that no other piece has
        codes = pd.factorize(pdf["cluster"])[0]
        codes = np.where(codes < 0, len(codes) + np.arange(len(codes)), codes)
        k = pack(rest[last], source, codes[last], capacity, per_source)
        parts.append(pd.DataFrame({"row": last, "piece": full[last], "start": full[last] * capacity, "stop": n[last], "bin": [f"{name}{x}" for x in k]}))
        none = np.flatnonzero(n == 0)
        parts.append(pd.DataFrame({"row": none, "piece": 0, "start": 0, "stop": 0, "bin": [None] * len(none)}))
        out = pd.concat([p for p in parts if len(p)]) if len(pdf) else parts[0]
        at = out["row"].to_numpy()
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[at], "copy": pdf["copy"].to_numpy()[at], "piece": out["piece"].to_numpy(), "start": out["start"].to_numpy(), "stop": out["stop"].to_numpy(), "bin": out["bin"].to_numpy()})

    return one.select("shard", "doc_id", "source", "n", "cluster", "copy").groupBy("shard").applyInPandas(packed, PLACED)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens (words) and cluster (a digest of the whole text)."""
    return docs.withColumns({"n_tokens": n_words(F.col(text_col)), "cluster": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words for all documents; equal texts never share a bin."""
    return pack_documents(measured(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
