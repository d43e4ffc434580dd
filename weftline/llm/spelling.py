"""Grouping of spelling variants: words one edit apart, by blocked Gram matrices.

*Words* are runs of letters of whole texts, lower-cased in A-Z only.  A fixed share of
them is misspelt on purpose (``misspelt``): it makes variants to find.  The vocabulary
holds those with at least ``least_chars`` code points and ``least`` occurrences.

*Blocks*: a pair of words of L and of L or L + 1 code points that are one inserted,
deleted or replaced code point apart agrees outside of one of four equal ranges of the L
places.  Every word is filed once for each range, as the shorter and as the longer word
of a pair, under what is left of it outside the range.  A block that holds more than
``most`` words is filed again by the quarters of its range, and so on down to ranges of
one place, where a block holds at most one word for each letter, and one for each two.
So blocks stay small whatever the vocabulary, and no pair is lost: a pair counts in the
first range that fits.

*Gram matrices*: inside a block, with ``c`` a matrix of letter counts (code points modulo
32), ``|a|^2 + |b|^2 - 2 c c^T`` holds all squared distances.  One edit moves at most two
counts by one, so only pairs at a distance of at most two go on, and only between equal
or adjacent lengths.  Common beginnings and ends then verify the edit.

*Forms*: a word's form is the near word with most occurrences, if it has at least
``ratio`` times the word's own; following forms to the last leads to its root, by doubled
pointers, so in the logarithm of the longest chain.

Edge cases: null and empty texts have no words; a null id counts as an empty one; rows
with equal ids count each.  Words of any length are compared whole.  An empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut, drop, table

#: What a word is, and which share of words loses a letter.
LETTERS = "[A-Za-zÀ-ÿ]+"
NOISE = 97

RANGES = 4
MOST = 2048  # words of a block
TILE = 1024  # rows of a Gram matrix
HELD = 4 << 20  # code points that are compared at once

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(s: Column) -> Column:
    return F.when(s.rlike("[A-Z]"), F.translate(s, _UPPER, _LOWER)).otherwise(s)


def misspelt(run: Column, doc_id: Column, noise: int = NOISE) -> Column:
    """The run without one code point, where ``noise`` divides the crc32 of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % noise == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = NOISE, least_chars: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of all documents; counts are added up inside tasks before they are shuffled."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS), F.lit(0))).alias("run"))
    words = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    word = misspelt(F.col("run"), F.col("id"), noise) if noise else F.col("run")
    words = words.select(word.alias("word")).where(F.char_length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _filed(rows: DataFrame, ranges: Column) -> DataFrame:
    """Rows (word, n, size) once for each of ``ranges`` (lo, hi), with the block of what lies outside."""
    longer = F.char_length("word") - F.col("size")
    rest = F.concat(F.substring(F.col("word"), F.lit(1), F.col("r.lo")), F.lit("\x00"), F.substring(F.col("word"), F.col("r.hi") + longer + 1, F.char_length("word")))
    out = rows.withColumn("r", F.explode(ranges)).select("word", "n", "size", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), F.xxhash64("size", "r.lo", "r.hi", rest).alias("block"))
    return out


def _split(lo: Column, hi: Column) -> Column:
    """Four equal parts of a range; a place each where it has no more than four."""
    size = hi - lo
    parts = F.least(size, F.lit(RANGES))
    place = lambda k: (lo + F.floor(size * k / parts)).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(place(k).alias("lo"), place(k + 1).alias("hi")))


def blocks(vocab: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, size, lo, hi, block): every word in every block that may hold a near one."""
    size = F.char_length("word")
    rows = vocab.select("word", "n", F.explode(F.array(size, size - 1)).alias("size")).where("size > 0")
    filed = _filed(rows, _split(F.lit(0), F.col("size")))
    done = None
    while True:
        full = filed.where("hi - lo > 1").groupBy("block").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most)
        full = cut(full.select("block"), "full")
        hot = full.count()
        here = filed if not hot else filed.join(_bounded(full, hot), "block", "left_anti")
        done = here if done is None else done.unionByName(here)
        if not hot:
            return done
        again = filed.join(_bounded(full, hot), "block", "left_semi")
        filed = cut(_filed(again.select("word", "n", "size", F.col("lo").alias("from"), F.col("hi").alias("to")), _split(F.col("from"), F.col("to"))), "filed")


def _bounded(keys: DataFrame, n: int, most: int = 100_000) -> DataFrame:
    return F.broadcast(keys) if n <= most else keys


def _letter_counts(words: list[np.ndarray]) -> np.ndarray:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.repeat(np.arange(len(words)), sizes) * 32 + (np.concatenate(words) & 31)
    return np.bincount(at, minlength=32 * len(words)).reshape(-1, 32).astype(np.float64)


def _padded(words: list[np.ndarray], width: int, right: bool) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint32)
    for row, w in zip(out, words, strict=True):
        if right:
            row[width - len(w) :] = w
        else:
            row[: len(w)] = w
    return out


def _common(a: list[np.ndarray], b: list[np.ndarray], right: bool) -> np.ndarray:
    """How many code points each pair has in common at its beginning (or end)."""
    width = max(map(len, b)) + 1
    differ = _padded(a, width, right) != _padded(b, width, right)
    if right:
        differ = differ[:, ::-1]
    differ[:, -1] = True
    return differ.argmax(axis=1)


def near_in_tile(words: list[np.ndarray], gram_of: np.ndarray, group: np.ndarray, size: np.ndarray, lo: np.ndarray, first: int, end: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (shorter, longer) of near words: rows first to end against rows first to stop."""
    norm = (gram_of**2).sum(axis=1)
    far = norm[first:end, None] + norm[None, first:stop] - 2 * gram_of[first:end] @ gram_of[first:stop].T
    long = np.fromiter((len(w) for w in words[first:stop]), np.int64, stop - first) - size[first:stop]
    fits = (far <= 2) & (group[first:end, None] == group[None, first:stop]) & ~((long[: end - first, None] == 1) & (long[None, :] == 1))
    i, j = np.nonzero(np.triu(fits, 1))
    swap = long[i] > long[j]
    i, j = np.where(swap, j, i) + first, np.where(swap, i, j) + first
    at = 0
    while at < len(i):
        width = len(words[j[at]]) + 1
        upto = at + max(1, HELD // width)
        if (widest := max(len(words[k]) for k in j[at:upto]) + 1) > width:
            upto = at + max(1, HELD // widest)
        a, b = i[at:upto], j[at:upto]
        of_a, of_b = [words[k] for k in a], [words[k] for k in b]
        head, tail = _common(of_a, of_b, False), _common(of_a, of_b, True)
        extra = np.array([len(y) - len(x) for x, y in zip(of_a, of_b, strict=True)])
        edit = np.where(extra == 0, head + tail == size[a] - 1, head + tail >= size[a])
        own = (lo[a] == 0) | (tail < size[a] - lo[a])
        yield a[edit & own], b[edit & own]
        at = upto


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs (a, na, b, nb) of rows (word, n, size, lo, block) sorted by size and block."""
    names = ["a", "na", "b", "nb"]

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        block = rows["block"].to_numpy()
        new = np.ones(len(block), bool)
        new[1:] = block[1:] != block[:-1]
        group = np.cumsum(new) - 1
        shared = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(shared):
            return
        rows, group = rows.take(pa.array(shared)), group[shared]
        text = rows["word"].combine_chunks()
        words = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in text.to_pylist()]
        n, size, lo = (rows[c].to_numpy() for c in ("n", "size", "lo"))
        counts = _letter_counts(words)
        for first in range(0, len(words), TILE):
            end = min(first + TILE, len(words))
            stop = int(np.searchsorted(group, group[end - 1], "right"))
            for a, b in near_in_tile(words, counts, group, size, lo, first, end, stop):
                if len(a):
                    yield pa.RecordBatch.from_arrays([text.take(pa.array(a)), pa.array(n[a]), text.take(pa.array(b)), pa.array(n[b])], names=names)

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= 4 * TILE:
            whole = pa.Table.from_batches(held).combine_chunks()
            block = whole["block"].to_numpy()
            last = int(np.flatnonzero(block != block[-1])[-1]) + 1 if block[0] != block[-1] else 0
            if last:
                yield from solve(whole.slice(0, last))
                held, rows = whole.slice(last).to_batches(), len(whole) - last
    if held:
        yield from solve(pa.Table.from_batches(held).combine_chunks())


def near_pairs(vocab: DataFrame, most: int = MOST) -> DataFrame:
    """(a, na, b, nb): every pair of words that one edit parts, once.

    The words of ``vocab`` are unique and have a code point at least.
    """
    rows = blocks(vocab, most).select("word", F.col("n").cast("long").alias("n"), F.col("size").cast("long").alias("size"), F.col("lo").cast("long").alias("lo"), "block")
    dealt = rows.repartition("block").sortWithinPartitions("size", "block")
    return dealt.mapInArrow(_near, "a string, na long, b string, nb long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the end of the chain of forms."""
    now = cut(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = cut(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(now)
        if met.where("moved").isEmpty():
            return met.select("word", "root")
        now = met.select("word", "root")
        now._weftline_path = met._weftline_path


def group_spellings(vocab: DataFrame, ratio: int = 2, most: int = MOST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of a vocabulary (word, n)."""
    vocab = cut(vocab, "words")
    pairs = cut(near_pairs(vocab, most), "pairs")
    none = [F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("m")]
    of = lambda word, n, other, m: pairs.select(F.col(word).alias("word"), F.col(n).alias("n"), F.col(other).alias("other"), F.col(m).alias("m"))
    rows = vocab.select("word", F.col("n").cast("long").alias("n"), *none).unionByName(of("a", "na", "b", "nb")).unionByName(of("b", "nb", "a", "na"))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("m")).alias("less"), "other")))
    seen = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    strong = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    seen = cut(seen.select("word", "n", "n_near", F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "forms")
    drop(vocab, pairs)
    return seen.join(roots(seen), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form, its root and its number of near words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return group_spellings(vocabulary(docs)).select("word", "form", "root", "n", "n_near", "form_n")


_TABLE = "SELECT range AS i, range::BIGINT AS c FROM range(256)"
for _ in range(8):
    _TABLE = f"SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM ({_TABLE})"

ORACLE = f"""
WITH RECURSIVE bytes AS MATERIALIZED ({_TABLE}),
runs AS MATERIALIZED (
  SELECT doc_id, translate(r, '{_UPPER}', '{_LOWER}') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY 1, 2),
crc AS (
  SELECT doc_id, run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h, 0 AS pos, 4294967295::BIGINT AS c FROM runs
  UNION ALL
  SELECT doc_id, run, h, pos + 1, xor(crc.c >> 8, bytes.c) FROM crc JOIN bytes ON bytes.i = (xor(crc.c, ('0x' || substr(h, 2 * pos + 1, 2))::BIGINT) & 255) WHERE 2 * pos < length(h)),
words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN v % {NOISE} = 0 THEN substr(run, 1, (v % length(run))::INT) || substr(run, (v % length(run))::INT + 2) ELSE run END AS word
    FROM (SELECT doc_id, run, xor(c, 4294967295) AS v FROM crc WHERE 2 * pos = length(h)) JOIN runs USING (doc_id, run))
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT word, n, other, m FROM (
    SELECT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
    UNION ALL SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
    UNION ALL SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word)),
forms AS MATERIALIZED (
  SELECT word, n, n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM (SELECT w.word, w.n, x.other, x.m, count(x.other) OVER (PARTITION BY w.word) AS n_near, row_number() OVER (PARTITION BY w.word ORDER BY x.m DESC NULLS LAST, encode(x.other)) AS nth FROM words w LEFT JOIN near x USING (word))
  WHERE nth = 1),
chain AS (SELECT word, word AS now FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.now WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, c.now AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.now AND e.form IS NULL
"""
