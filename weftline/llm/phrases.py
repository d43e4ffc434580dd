"""Phrase collocation mining with count streams in prefix and suffix order.

Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends; words are
runs without space or tab.  All counts are per language.

*Counting* works up from words to longer phrases: a phrase occurs at least ``least``
times only if both phrases that it is without its first or last word do.  Each order
first adds up the occurrences of 64-bit phrase hashes, in packed sorted runs that every
task merges before they are shuffled, dealt by ranges of the hash; those seen often
enough become a bit filter of fixed size.  A last pass counts, as strings, only phrases
that all filters let pass.  Hashes and filters can let too much pass, never too little,
and the strings' own counts decide: results are exact.

*Streams*: the table of frequent phrases of all lengths is laid out twice, sorted by its
words and sorted by its words from the last to the first.  In prefix order the beginning
of a phrase is the last shorter phrase of its length that came by, so one lockstep pass
hands every phrase the counts of all its beginnings; in suffix order those of all its
ends.  Extensions are merged back the same way: each phrase sends its count to the phrase
without its last and to the one without its first word.  No count is looked up by hash.

*Scores*: cutting a phrase of count a into parts of counts l and r scores
``a^2 / (l r)`` in millionths, floored, in exact decimals; the lowest-scoring cut counts.
A phrase goes if a longer one that holds it has at least ``held`` per cent of its count.

Edge cases: null texts are empty; a null language counts as ``und``.  Texts are read
whole; words and pieces may have any length.  Rows with equal ids count each; no id is
needed.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running
from ..operators.windows import top_k_spread
from . import hashing
from .scratch import cut, drop, table
from .sketch import IdFilter, id_filter

#: What ends a piece.
PIECE_ENDS = ".,;:!?"
HELD = 1 << 21  # windows that a task sorts at once
PER_BUCKET = 1 << 22  # windows whose hashes lie in one range

_ENDS, _SEPARATORS = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[[*map(ord, PIECE_ENDS), 10, 11, 12, 13]] = True
_SEPARATORS[[9, 32]] = True
_SEPARATORS |= _ENDS
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Windows:
    """The words of a run of texts, and their windows of several words inside a piece."""

    def __init__(self, raw: bytes, offsets: np.ndarray, seeds: np.ndarray):
        self.data = _LOWER[np.frombuffer(raw, np.uint8)]
        inner = ~_SEPARATORS[self.data]
        edge = np.zeros(len(inner) + 1, bool)
        edge[1:-1] = inner[1:] != inner[:-1]
        edge[offsets] = True
        at = np.flatnonzero(edge)
        inside = inner[at[:-1]] if len(inner) else np.zeros(0, bool)
        self.starts, self.ends = at[:-1][inside], at[1:][inside]
        self.owner = np.searchsorted(offsets, self.starts, "right") - 1
        ended = np.zeros(len(inner) + 1, np.int64)
        np.cumsum(_ENDS[self.data], out=ended[1:])
        piece = ended[self.starts]
        self.goes_on = (piece[1:] == piece[:-1]) & (self.owner[1:] == self.owner[:-1])
        h = hashing.spans_hash(self.data, self.starts, self.ends)
        self.h = hashing.mix(h ^ seeds[self.owner])

    def hashes(self, n: int) -> np.ndarray:
        """A hash of each window of n words, whether it is one or not."""
        if n == 1:
            return self.h
        out = np.zeros(max(0, len(self.h) - n + 1), np.uint64)
        for k in range(n):
            out += self.h[k : k + len(out)] * hashing._GRAM[k]
        return hashing.mix(out)

    def passing(self, filters: list[IdFilter], n: int) -> np.ndarray:
        """Where windows of n words start whose parts of n - 1 words the filters let pass."""
        ok = np.ones(len(self.h), bool)
        for k in range(1, n):
            if k > 1:
                ok = self._longer(ok, k)
            at = np.flatnonzero(ok)
            ok[at] = filters[k - 1].may_hold(self.hashes(k)[at].view(np.int64))
        return np.flatnonzero(self._longer(ok, n) if n > 1 else ok)

    def _longer(self, ok: np.ndarray, n: int) -> np.ndarray:
        m = max(0, len(self.h) - n + 1)
        return ok[:m] & ok[1 : m + 1] & self.goes_on[:m]

    def phrases(self, first: np.ndarray, n: int) -> pa.Array:
        """The windows of n words that start at ``first``, their words parted by one space."""
        parts = (first[:, None] + np.arange(n)).ravel()
        sizes = self.ends[parts] - self.starts[parts]
        spaced = sizes + (np.tile(np.arange(n), len(first)) < n - 1)
        begin = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(spaced, out=begin[1:])
        source = np.repeat(self.starts[parts] - begin[:-1], spaced) + np.arange(begin[-1])
        out = self.data[np.minimum(source, len(self.data) - 1)]
        spaces = begin[1:][spaced > sizes] - 1
        out[spaces] = 32
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(begin[::n].copy()), pa.py_buffer(out)).cast(pa.string())


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[Windows, pa.Array]]:
    langs = batch.column(0)
    names = langs.unique()
    seed = {x: xxhash.xxh64_intdigest(x or "") for x in names.to_pylist()}
    seeds = np.array([seed[x] for x in langs.to_pylist()], np.uint64)
    for first, end, raw, offsets in hashing.runs(batch.column(1)):
        yield Windows(raw, offsets, seeds[first:end]), langs.slice(first, end - first)


def _counted(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, where each is first, and how often it is there."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
    times = np.diff(np.append(new, len(h))) if n is None else np.add.reduceat(n[order], new) if len(h) else n
    return h[new], order[new], times


def phrase_counts(rows: DataFrame, orders: list[int], filters: list[IdFilter]) -> DataFrame:
    """(lang, phrase, size, f, h): occurrences of windows that the filters let pass.

    ``rows`` are (lang, text).  Without filters, all words.
    """
    shared = rows.sparkSession.sparkContext.broadcast(filters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, langs in _runs(batch):
                for n in orders:
                    at = w.passing(shared.value, n)
                    hashes = w.hashes(n)[at]
                    if n <= len(shared.value):
                        ok = shared.value[n - 1].may_hold(hashes.view(np.int64))
                        at, hashes = at[ok], hashes[ok]
                    h, first, times = _counted(hashes)
                    at = at[first]
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(w.owner[at])), w.phrases(at, n), pa.array(np.full(len(at), n, np.int32)), pa.array(times.astype(np.int64)), pa.array(h.view(np.int64))], names=["lang", "phrase", "size", "f", "h"])

    parts = rows.mapInArrow(count, "lang string, phrase string, size int, f long, h long")
    return parts.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"), F.min("h").alias("h"))


def frequent_hashes(rows: DataFrame, n: int, filters: list[IdFilter], least: int, total: int) -> DataFrame:
    """(h): hashes of windows of n words, of which ``total`` are there at most, seen ``least`` times.

    Hash ranges are sized by the data; each task sends a sorted run of each.
    """
    shared = rows.sparkSession.sparkContext.broadcast(filters)
    buckets = max(16, -(-total // PER_BUCKET))
    bounds = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)

    def runs_of(h: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.searchsorted(h, bounds), [len(h)]])
        there = np.flatnonzero(np.diff(ends))
        part = lambda x: pa.array([x[ends[b] : ends[b + 1]].tobytes() for b in there], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), part(h), part(times.astype(np.uint32))], names=["bucket", "hashes", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for w, _ in _runs(batch):
                held.append(w.hashes(n)[w.passing(shared.value, n)])
                size += len(held[-1])
                if size >= HELD:
                    h, _, times = _counted(np.concatenate(held))
                    held, size = [], 0
                    yield runs_of(h, times)
        if size:
            h, _, times = _counted(np.concatenate(held))
            yield runs_of(h, times)

    def merge(rows: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["hashes"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["times"].to_pylist()]).astype(np.int64)
        h, _, times = _counted(h, n)
        return pa.table({"h": h[times >= least].view(np.int64)})

    packed = rows.mapInArrow(count, "bucket int, hashes binary, times binary")
    return packed.groupBy("bucket").applyInArrow(merge, "h long")


def frequent_phrases(docs: DataFrame, least: int, most_words: int, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases up to ``most_words`` seen ``least`` times, and (lang, n) of all words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = cut(phrase_counts(rows, [1], []), "words")
    totals = cut(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = words.where(F.col("f") >= least)
    filters = [id_filter(often, "h")]
    for n in range(2, most_words + 1):
        seen = cut(frequent_hashes(rows, n, filters, least, total), "hashes")
        filters.append(id_filter(seen, "h"))
        drop(seen)
    longer = phrase_counts(rows, list(range(2, most_words + 1)), filters).where(F.col("f") >= least)
    return cut(often.unionByName(longer).drop("h"), "phrases"), totals


def _streams(grams: DataFrame, most_words: int) -> DataFrame:
    """``grams`` with l1.. and r1..: counts of their first and last k words, and ext, the largest count of an extension."""
    shorter = range(1, most_words)
    of = lambda k: ("last", F.when(F.col("size") == k, F.col("f")))
    rows = grams.withColumn("words", F.split("phrase", " "))
    rows = running(rows, ["lang"], ["words"], {f"l{k}": of(k) for k in shorter})
    rows = running(rows.withColumn("words", F.reverse("words")), ["lang"], ["words"], {f"r{k}": of(k) for k in shorter})
    rows = cut(rows.withColumn("words", F.reverse("words")), "streams")
    inner = F.array(F.slice("words", 1, F.col("size") - 1), F.slice("words", 2, F.col("size") - 1))
    sent = rows.where("size > 2").select("lang", F.explode(inner).alias("words"), F.col("f").alias("ext"))
    merged = sent.groupBy("lang", "words").agg(F.max("ext").alias("ext"))
    return rows.join(merged.hint("merge"), ["lang", "words"], "left")


def _best_cut(most_words: int) -> Column:
    """(score, k, l, r) of the lowest-scoring cut of a phrase."""
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = []
    for size in range(2, most_words + 1):
        for k in range(1, size):
            above = wide("f") * wide("f") * F.lit(1_000_000).cast("decimal(7,0)")
            score = F.call_function("div", above, wide(f"l{k}") * wide(f"r{size - k}"))
            cuts.append(F.when(F.col("size") == size, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{size - k}").alias("r"))))
    return F.array_min(F.array_compact(F.array(*cuts)))


def collocations(docs: DataFrame, least: int = 10, most_words: int = 3, held: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score, k) of all phrases of two words and more that stay."""
    grams, totals = frequent_phrases(docs, least, most_words, lang_col, text_col)
    rows = _streams(grams, most_words).where("size > 1")
    rows = rows.where(F.coalesce(F.col("ext") * 100 < F.col("f") * held, F.lit(True))).withColumn("cut", _best_cut(most_words))
    return rows.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "phrase", "size", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score", "cut.k")


def op11_phrase_collocations(spark, sf_dir: str, most: int = 2000) -> DataFrame:
    """Each language's first 2,000 collocations."""
    found = cut(collocations(table(spark, sf_dir, "documents").select("lang", "text")), "collocations")
    best = top_k_spread(found, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], most, "rank", by=["phrase"])
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH pieces AS MATERIALIZED (
  SELECT row_number() OVER () AS p, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS MATERIALIZED (SELECT p, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces)),
windows AS MATERIALIZED (SELECT lang, w, lead(w) OVER b AS w2, lead(w, 2) OVER b AS w3 FROM words WINDOW b AS (PARTITION BY p ORDER BY i)),
grams AS (
  SELECT lang, 1 AS size, w AS phrase FROM windows UNION ALL SELECT lang, 2, w || ' ' || w2 FROM windows WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM windows WHERE w3 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY 1),
candidates AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
parts AS MATERIALIZED (SELECT lang, phrase, size, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
often AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 10),
heads AS MATERIALIZED (SELECT c.*, x.f AS l FROM parts c JOIN often x ON x.lang = c.lang AND x.phrase = c.head),
cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, k, l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (l::HUGEINT * y.f))::BIGINT AS score
  FROM heads c JOIN often y ON y.lang = c.lang AND y.phrase = c.rest),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a AS longer FROM candidates WHERE size = 3),
kept AS (SELECT s.* FROM scored s LEFT JOIN (SELECT lang, phrase, max(longer) AS longer FROM held GROUP BY 1, 2) h USING (lang, phrase) WHERE s.size = 3 OR h.longer IS NULL OR 100 * h.longer < 50 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000
"""
