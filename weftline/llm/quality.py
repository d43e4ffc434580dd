"""Quality classifier by importance resampling of hashed n-gram models.

Two bag-of-n-grams models over 2**16 hash buckets: one of the *target* text
(labelled good) and one of the *raw* text (every document).  A document's
importance weight is the product of target over raw probability of its
features; ``log_weight`` is its logarithm.  Features are word unigrams and
bigrams, as in plain importance resampling, and n-grams of word *shapes* (case,
digits, punctuation runs, repetition of the word before), which are hashed into
the same buckets and let the models see layout.

``k`` documents are then drawn without replacement, with probabilities
proportional to the weights, by Gumbel top-k: the k largest of ``log_weight +
Gumbel noise``.  The noise comes from a hash of seed and id, so a rerun or a
recomputed task draws the same.  By default k is the number of documents whose
log weight passes a cutoff, which held-out labelled documents set: half way
between the two weights where true positive plus true negative rate peaks.

The raw model and k cover every document.  Target model and cutoff come from at
most ``max_labelled`` labelled rows (by hash of id), half for each.

Texts are scored twice, once for the k-th key and once for the output: keeping the
first scores would mean joining them back by id, which shuffles every text, or copying
the table, and ids need not be unique.

Edge cases: texts are scored whole, in runs whose memory follows the largest text.  Ids
of any whole-number type draw alike.  Other columns stay; those of the three output names
are replaced.  A null or empty text has weight 0 (log), like a document about which
the models say nothing.  Without labels of both kinds nothing is rejected.  Rows
with equal ids have equal keys and share their fate, as do ties at the k-th key:
all are kept; so do rows with a null id, which share one draw and teach nothing.  An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .scratch import cut, table
from .sketch import vector_sum

BUCKETS = 1 << 16
MAX_LABELLED = 20_000
SEED = 7

_CLASS = np.full(256, 2, np.uint8)  # 0 space, 1 word, 2 punctuation
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_lo:_hi] = 1
_UPPER, _DIGIT, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58], _LOWER[97:123] = True, True, True


def features(raw: bytes, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket and text index of every feature of a run of texts."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offsets] = True
    at = np.flatnonzero(new)
    starts, ends = at[:-1], at[1:]
    inside = kind[starts] != 0
    starts, ends = starts[inside], ends[inside]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.frombuffer(raw.lower(), np.uint8)
    h = hashing.spans_hash(low, starts, ends)
    owner = np.searchsorted(offsets, starts, "right") - 1

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=sums[1:])
        return sums[ends] - sums[starts]

    word = kind[starts] == 1
    size = np.minimum(ends - starts, 255)
    upper, digit, lower = count(_UPPER), count(_DIGIT), count(_LOWER)
    shape = np.where(word, 1 + (upper > 0) + 2 * ((upper > 1) & (lower == 0)) + 4 * (digit > 0), 16 + np.minimum(size, 4))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    shape = (shape + 32 * same).astype(np.uint64)
    pair = owner[1:] == owner[:-1]
    triple = owner[2:] == owner[:-2]
    g = hashing._GRAM
    grams = [
        hashing.mix(h + np.uint64(1)),
        hashing.mix(h[:-1] * g[0] + h[1:] * g[1])[pair],
        hashing.mix(shape[:-1] * g[2] + shape[1:] * g[3] + np.uint64(2))[pair],
        hashing.mix(shape[:-2] * g[4] + shape[1:-1] * g[5] + shape[2:] * g[6] + np.uint64(3))[triple],
    ]
    owners = [owner, owner[1:][pair], owner[1:][pair], owner[2:][triple]]
    return (np.concatenate(grams) & np.uint64(buckets - 1)).astype(np.int64), np.concatenate(owners)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket, one added to each count."""
    if not target.sum():
        return np.zeros(len(raw))
    t, r = target + 1.0, raw + 1.0
    return np.log(t / t.sum()) - np.log(r / r.sum())


def cutoff(weights: np.ndarray, good: np.ndarray) -> float:
    """The log weight that best parts held-out labels; minus infinity without both kinds."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    bad_below = np.cumsum(~g) / (~g).sum()
    good_below = np.cumsum(g) / g.sum()
    gain = bad_below - good_below
    gain[:-1][w[1:] == w[:-1]] = -1
    best = int(np.argmax(gain))
    return float((w[best] + w[min(best + 1, len(w) - 1)]) / 2) if gain[best] > 0 else float("-inf")


def labelled_sample(labels: DataFrame, most: int, id_col: str, label_col: str) -> dict[int, tuple[bool, bool]]:
    """id to (good, used to fit): at most ``most`` labelled rows, by hash of id."""
    one = labels.where(f"`{id_col}` is not null and `{label_col}` is not null").groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max(label_col).cast("int").alias("q"))
    rows = one.orderBy(F.xxhash64(F.lit(SEED), "i"), "i").limit(most).collect()
    return {r["i"]: (r["q"] > 0, k % 2 == 0) for k, r in enumerate(rows)}


def fit(rows: DataFrame, sample: dict[int, tuple[bool, bool]]) -> np.ndarray:
    """The log ratio of each bucket; ``rows`` are (doc_id, text) of every document."""
    target_ids = np.array(sorted(i for i, (good, used) in sample.items() if good and used), np.int64)

    def tally(batch: pa.RecordBatch, total: np.ndarray) -> None:
        ids = batch.column(0).fill_null(-(2**63)).to_numpy()
        target = np.isin(ids, target_ids)
        for first, end, raw, offsets in hashing.runs(batch.column(1)):
            bucket, owner = features(raw, offsets)
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            if target[first:end].any():
                total[1] += np.bincount(bucket[target[first:end][owner]], minlength=BUCKETS)

    counts = vector_sum(rows, 2, BUCKETS, tally)
    return log_ratio(counts[1], counts[0])


def weigher(spark: SparkSession, ratio: np.ndarray):
    """A column function: the log weight of a text."""
    spread = spark.sparkContext.broadcast(ratio)

    @F.arrow_udf(T.DoubleType())
    def weight(texts: pa.Array) -> pa.Array:
        out = []
        for first, end, raw, offsets in hashing.runs(texts):
            bucket, owner = features(raw, offsets)
            out.append(np.bincount(owner, weights=spread.value[bucket], minlength=end - first))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return weight


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096, few: int = 20_000) -> float:
    """The k-th largest value, by histograms that narrow down on it.

    A histogram's ``bins`` counts, and in the end at most ``few`` values, reach
    the driver.  Plus infinity for k = 0; minus infinity if there are fewer values.
    """
    if k <= 0:
        return float("inf")
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if k >= n:
        return float("-inf")
    part = df
    while n > few and lo < hi:
        width = (hi - lo) / bins
        at = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).alias("at")
        rows = part.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).orderBy(F.desc("at")).collect()
        for r in rows:
            if k <= r["n"]:
                break
            k -= r["n"]
        if (r["lo"], r["hi"], r["n"]) == (lo, hi, n):
            break
        lo, hi, n = r["lo"], r["hi"], r["n"]
        part = df.where(F.col(col).between(lo, hi))
    if lo == hi:
        return lo
    return part.orderBy(F.desc(col)).limit(k).agg(F.min(col)).first()[0]


def draw_key(log_weight: Column, key: Column, seed: int) -> Column:
    """The log weight plus Gumbel noise from a hash of seed and id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 12).cast("double") + 0.5) / float(1 << 52)
    return log_weight - F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED, seed: int = SEED, names: tuple[str, str, str] = ("log_weight", "draw_key", "selected")) -> DataFrame:
    """``docs`` with log weight, draw key and whether drawn, under ``names``; no text is shuffled."""
    spark = docs.sparkSession
    sample = labelled_sample(labels, max_labelled, id_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weight = weigher(spark, fit(rows, sample))
    keyed = rows.select("doc_id", weight("text").alias("log_weight"))
    keyed = cut(keyed.withColumn("draw_key", draw_key(F.col("log_weight"), F.col("doc_id"), seed)), "keys")
    if k is None:
        held = [(i, good) for i, (good, used) in sample.items() if not used]
        ids = spark.createDataFrame(held, "doc_id long, good boolean")
        found = keyed.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("log_weight").alias("w"), F.min("good").alias("g")).collect()
        part = cutoff(np.array([r["w"] for r in found]), np.array([r["g"] for r in found], bool))
        k = keyed.where(F.col("log_weight") > part).count()
    least = kth_largest(keyed, "draw_key", k)
    out = docs.withColumn(names[0], weight(F.col(text_col).cast("string")))
    out = out.withColumn(names[1], draw_key(F.col(names[0]), F.col(id_col).cast("long"), seed))
    return out.withColumn(names[2], F.col(names[1]) >= F.lit(least))


def op9_quality_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document's importance weight, draw key and whether it is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "draw_key", "selected")
