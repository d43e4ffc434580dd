"""Fuzzy line dedup: MinHash bands, exact Jaccard checks, distributed union-find.

A line is compared stripped and lower-cased; blank lines are never touched.

1. Every line gets a 64-bit hash and, from its shingles of 5 characters, ``BANDS *
   ROWS`` MinHash values.  They are folded into one key a band and, four bits a
   value, into a sketch.  Two lines of Jaccard similarity 0.8 share a band with
   probability 0.998.
2. Equal lines collapse (partially before the shuffle), each with its first
   occurrence by document id, then line number.
3. Lines that share a band key meet in a list.  Pairs whose sketches agree in fewer
   than ``AGREE`` of the 48 values are left out: at similarity 0.8 that loses another
   0.0003, below 0.4 it leaves three pairs in a hundred.
4. Short lists give all pairs that are left, long ones stars around heads, very long
   ones (by their counts) first of all a star around one leader.  These pairs are held
   against each other by the exact Jaccard similarity of their shingle sets;
   distributed union-find joins what links.
5. What then lies in one component needs no more comparison.  Only long lists in which
   sketches of different components still agree are solved by exact similarity, whole
   or in cells of two blocks, so that no pair of a list is left out.
6. Every component keeps one line, its first occurrence; all other occurrences are
   removed from their documents.

One changed character inside a line of n costs 5 of its n - 4 shingles on either side,
so such lines link from 49 characters on, shorter ones by edits near their ends.
Lines shorter than one shingle are their own shingle, so only equal ones link.

Only lines that take part in a comparison have their text fetched.  The id filters
that are broadcast are sized by what they hold, up to 16 MB; beyond that they let more
rows pass to the join behind them.  Very frequent lines, heads and components are
spread over partitions.  A document's removed lines are gathered by id and hash of its
text, so many rows with one id (or none) do not meet in one row.

Edge cases: a null text stays null, an empty one empty; texts and lines of any length
are taken whole.  Rows with equal ids (repeated rows) count as one document and lose
the same lines; a null id sorts first.  An empty table gives an empty result.  Other
columns stay as they are, but for the two counts (whose names are parameters) and
``n_chars``, if there is one; names that start with ``__dedup_`` are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components, merged
from ..operators.skew import hot_keys, spread_join
from . import hashing
from .lists import dealt, met, whole_lists
from .scratch import cut, drop, table
from .sketch import IdFilter, id_filter

SHINGLE = 5
BANDS = 12
ROWS = 4
AGREE = 30  # of BANDS * ROWS values
PERCENT = 80
SHORT_LIST = 24
LIST_BLOCK = 4096
RUN_CHARS = 400_000
SEEN = 50_000  # lines that a task remembers, so as not to sign equal ones again
_WORDS = BANDS * ROWS // 16
_BYTES = 8 * (BANDS + _WORDS)
_MARKS = [f"s{k}" for k in range(_WORDS)]
_RANDOM = np.random.default_rng(11)
_FACTORS = (_RANDOM.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_MASKS = _RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_ROLL = (_RANDOM.integers(1, 2**31, 64, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)


def normal(line: str) -> str:
    return line.strip().lower()


def line_hash(line: str) -> int:
    """Signed 64-bit hash of a normalised line."""
    h = xxhash.xxh3_64_intdigest(line)
    return h - 2**64 if h >= 2**63 else h


def shingles_of(line: str, size: int = SHINGLE) -> set[str]:
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def similar(one: set[str], two: set[str], percent: int = PERCENT) -> bool:
    both = len(one & two)
    return 100 * both >= percent * (len(one) + len(two) - both)


def signatures(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """One key a band, and the sketch, of each line, all at least ``size`` characters long."""
    lengths = np.array([len(x) for x in lines], np.int64)
    text = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(text) - size + 1
    h = np.zeros(n, np.uint32)
    for k in range(size):
        h += text[k : k + n] * _ROLL[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    starts = np.cumsum(lengths) - lengths
    edges = np.stack([starts, starts + lengths - size + 1], axis=1).reshape(-1)[:-1]
    keys, marks = np.zeros((len(lines), BANDS), np.uint64), np.zeros((len(lines), _WORDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(lines), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat((h ^ _MASKS[k]) * _FACTORS[k], edges)[::2]
            key = hashing.mix(key + least)
            marks[:, k // 16] |= ((least * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint64) << np.uint64(4 * (k % 16))
        keys[:, band] = key
    return keys.view(np.int64), marks


_LOW_BITS = 0x1111111111111111


def agreeing(marks: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many values sketches agree."""
    x = marks ^ other
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return BANDS * ROWS - np.bitwise_count(x & np.uint64(_LOW_BITS)).sum(axis=-1, dtype=np.int64)


def agreeing_columns(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(BANDS * ROWS)
    for one, two in zip(a, b, strict=True):
        x = one.bitwiseXOR(two)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        out = out - F.bit_count(x.bitwiseAND(F.lit(_LOW_BITS)))
    return out


def _hashes(text: str | None) -> list[tuple[int, str]]:
    """(line number, normalised line) of the lines that are not blank."""
    return [(k, x) for k, line in enumerate((text or "").split("\n")) if (x := normal(line))]


_LINES = "doc_id long, row long, line int, h long, sig binary"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line that is not blank: where it is, its hash, and its signature once."""
    seen: set[int] = set()

    def flush() -> pa.RecordBatch:
        hashes = [line_hash(x) for x in texts]
        signed = []
        for i, (h, x) in enumerate(zip(hashes, texts, strict=True)):
            if len(x) >= SHINGLE and h not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(h)
                signed.append(i)
        raw = b""
        if signed:
            keys, marks = signatures([texts[i] for i in signed])
            raw = np.concatenate([keys.view(np.uint64), marks], axis=1).tobytes()
        has = np.zeros(len(texts), bool)
        has[signed] = True
        ends = np.concatenate([[0], np.cumsum(has * _BYTES)]).astype(np.int32)
        sig = pa.Array.from_buffers(pa.binary(), len(texts), [pa.py_buffer(np.packbits(has, bitorder="little").tobytes()), pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(places, pa.int32()), pa.array(hashes, pa.int64()), sig], names=["doc_id", "row", "line", "h", "sig"])

    ids, rows, places, texts, size = [], [], [], [], 0
    for batch in batches:
        for i, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            for k, x in _hashes(text.as_py()):
                ids.append(i)
                rows.append(row)
                places.append(k)
                texts.append(x)
                size += len(x)
                if size >= RUN_CHARS:
                    yield flush()
                    ids, rows, places, texts, size = [], [], [], [], 0
    if texts:
        yield flush()


def _unpacked(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and sketches of a column of signatures without nulls."""
    col = col.cast(pa.large_binary())
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    both = np.frombuffer(memoryview(col.buffers()[2] or b"")[ends[0] : ends[-1]], np.uint64).reshape(-1, BANDS + _WORDS)
    return both[:, :BANDS].view(np.int64), both[:, BANDS:]


def _all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(_unpacked(batch.column(0))[0]).reshape(-1))], names=["key"])


def _members(signed: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, sid, sketch): every signed line under each of its (likely) shared keys."""
    words = signed.sparkSession.sparkContext.broadcast(id_filter(shared, "key").words)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = IdFilter(words.value)
        for batch in batches:
            h = batch.column(0).to_numpy()
            keys, marks = _unpacked(batch.column(1))
            at, band = np.nonzero(ids.may_hold(np.ascontiguousarray(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[at, band]), pa.array(h[at]), *[pa.array(marks[at, k].view(np.int64)) for k in range(_WORDS)]], names=["key", "sid", *_MARKS])

    return signed.select("h", "sig").mapInArrow(likely, "key long, sid long, " + ", ".join(f"{m} long" for m in _MARKS))


def _marks_of(cols: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([cols[m].view(np.uint64) for m in _MARKS], axis=1)


def stars(marks: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs (head, other) in which every row with an agreeing one occurs, and which rows those are."""
    n = len(marks)
    held, near_some = np.zeros(n, bool), np.zeros(n, bool)
    out = []
    for h in range(n - 1):
        near = h + 1 + np.flatnonzero(agreeing(marks[h + 1 :], marks[h]) >= AGREE)
        if not len(near):
            continue
        near_some[h] = near_some[near] = True
        new = near[~held[near]]
        if len(new):
            out += [(h, int(j)) for j in new]
            held[new] = True
        elif not held[h]:
            out.append((int(near[0]), h))
        held[h] = True
    return out, near_some


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (sid, other) of lists; and rows of long lists that agree with another one (other is null)."""
    for cols, _ in whole_lists(batches):
        new = np.ones(len(cols["list"]), bool)
        new[1:] = (cols["list"][1:] != cols["list"][:-1]) | (cols["sid"][1:] != cols["sid"][:-1])
        key, sid, marks = cols["list"][new], cols["sid"][new], _marks_of(cols)[new]
        bounds = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        length = np.repeat(np.diff(bounds), np.diff(bounds))
        found = [np.zeros((0, 2), np.int64)]
        for d in range(1, SHORT_LIST):
            i = np.flatnonzero((length[d:] <= SHORT_LIST) & (key[d:] == key[:-d]))
            if not len(i):
                break
            i = i[agreeing(marks[i], marks[i + d]) >= AGREE]
            found.append(np.stack([sid[i], sid[i + d]], axis=1))
        rows = [np.zeros(0, np.int64)]
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if e - s > SHORT_LIST:
                pairs, near_some = stars(marks[s:e])
                if pairs:
                    found.append(sid[s:e][np.array(pairs)])
                    rows.append(s + np.flatnonzero(near_some))
        pairs, rows = np.unique(np.concatenate(found), axis=0), np.concatenate(rows)
        none = pa.nulls(len(pairs), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *[none] * _WORDS], names=["list", "sid", "other", *_MARKS])
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(sid[rows]), pa.nulls(len(rows), pa.int64()), *[pa.array(marks[rows, k].view(np.int64)) for k in range(_WORDS)]], names=["list", "sid", "other", *_MARKS])


def _texts(docs: DataFrame, wanted: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(h, x): the normalised text of the wanted lines (h, doc)."""
    ctx = docs.sparkSession.sparkContext
    lines, ids = ctx.broadcast(id_filter(wanted, "h").words), ctx.broadcast(id_filter(wanted, "doc").words)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_line, by_doc = IdFilter(lines.value), IdFilter(ids.value)
        for batch in batches:
            at = batch.column(0)
            ok = by_doc.may_hold(at.fill_null(0).to_numpy()) | at.is_null().to_numpy(zero_copy_only=False)
            part = batch.filter(pa.array(ok))
            for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                found = list({x: None for _, x in _hashes(text.as_py())})
                hashes = np.array([line_hash(x) for x in found], np.int64)
                keep = np.flatnonzero(by_line.may_hold(hashes))
                if len(keep):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(keep), pa.int64()), pa.array(hashes[keep]), pa.array([found[k] for k in keep], pa.string())], names=["doc", "h", "x"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(fetch, "doc long, h long, x string")
    same = (F.col("f.h") == F.col("w.h")) & F.col("f.doc").eqNullSafe(F.col("w.doc"))
    return rows.alias("f").join(wanted.alias("w"), same).select("f.h", "f.x").dropDuplicates(["h"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are similar enough.

    A head's text comes once before the texts it is held against; very many of those
    are spread over several copies of the head.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            ok = []
            for b, own in zip(batch.column(2).to_pylist(), shingle_sets(batch.column(3)), strict=True):
                if b is None:
                    head = own
                    ok.append(False)
                    continue
                low, high = sorted((len(head), len(own)))
                if 100 * low < PERCENT * high:
                    ok.append(False)
                    continue
                at = np.searchsorted(head, own)
                both = int((head[np.minimum(at, len(head) - 1)] == own).sum())
                ok.append(100 * both >= PERCENT * (len(head) + len(own) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    hot = hot_keys(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a")
    if hot is None:
        pairs = pairs.select("a", "b", F.lit(0).alias("part"))
    else:
        pairs = pairs.join(F.broadcast(hot), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("__salts")), F.lit(0)).cast("int").alias("part"))
    others = pairs.join(texts.select(F.col("h").alias("b"), "x"), "b").select("a", "part", "b", "x")
    heads = pairs.select("a", "part").distinct().join(texts.select(F.col("h").alias("a"), "x"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "x")
    rows = heads.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(check, "a long, b long")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of lists whose sketch agrees with one of another component."""
    for cols, bounds in whole_lists(batches):
        marks, keep = _marks_of(cols), []
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            comp, side = cols["comp"][s:e], cols["side"][s:e]
            if (comp == comp[0]).all():
                continue
            some = np.zeros(e - s, bool)
            for h in range(e - s - 1):
                j = h + 1 + np.flatnonzero((comp[h + 1 :] != comp[h]) & met(side[h + 1 :], side[h]))
                j = j[agreeing(marks[s + j], marks[s + h]) >= AGREE]
                if len(j):
                    some[h] = some[j] = True
            keep.append(s + np.flatnonzero(some))
        at = np.concatenate(keep) if keep else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cols[c][at]) for c in ("list", "side", "sid", "comp", *_MARKS)], names=["list", "side", "sid", "comp", *_MARKS])


def shingle_sets(lines: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct 64-bit hashes of each line's shingles, ascending; lines of any length.

    Lines are hashed in runs of about ``RUN_CHARS`` characters.
    """
    run, chars = [], 0
    for x in lines:
        run.append(x.as_py())
        chars += len(run[-1])
        if chars >= RUN_CHARS:
            yield from _run_sets(run, size)
            run, chars = [], 0
    yield from _run_sets(run, size)


def _run_sets(lines: list[str], size: int) -> Iterator[np.ndarray]:
    text = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(text) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):  # a polynomial of the characters, then mixed
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += text[k : k + n]
    h = hashing.mix(h)
    ends = np.cumsum([len(x) for x in lines])
    for e, x in zip(ends, lines, strict=True):
        h[e - len(x) : max(e - len(x), e - size + 1)].sort()
    new = np.ones(n, bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    for e, x in zip(ends, lines, strict=True):
        at = e - len(x)
        if len(x) < size:  # its own shingle, told apart by its length
            short = np.uint64(len(x))
            for c in text[at:e]:
                short = np.uint64((int(short) * 0x9E3779B97F4A7C15 + int(c)) % 2**64)
            yield hashing.mix(np.array([short]))
        else:
            new[at] = True
            yield h[at : e - size + 1][new[at : e - size + 1]]


def spanning_links(texts: list[str], side: np.ndarray, comp: np.ndarray, marks: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join a list's lines as all links between agreeing ones would."""
    sets = list(shingle_sets(pa.array(texts, pa.string())))
    size = np.array([len(x) for x in sets], np.int64)
    flat, start = np.concatenate(sets), np.cumsum(size) - size
    comp = np.unique(comp, return_inverse=True)[1]
    out = []
    for h in range(len(sets) - 1):
        j = h + 1 + np.flatnonzero((comp[h + 1 :] != comp[h]) & met(side[h + 1 :], side[h]))
        j = j[(100 * np.minimum(size[j], size[h]) >= percent * np.maximum(size[j], size[h])) & (agreeing(marks[j], marks[h]) >= AGREE)]
        if not len(j):
            continue
        lengths = size[j]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(start[j], lengths)
        hit = np.searchsorted(sets[h], flat[at])
        same = sets[h][np.minimum(hit, size[h] - 1)] == flat[at]
        both = np.add.reduceat(same, ends - lengths, dtype=np.int64)
        for k in j[100 * both >= percent * (size[h] + lengths - both)]:
            if comp[k] != comp[h]:
                out.append((h, int(k)))
                comp[comp == comp[k]] = comp[h]
    return out


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of whole long lists."""
    for cols, bounds in whole_lists(batches):
        a, b, marks = [], [], _marks_of(cols)
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            for i, j in spanning_links(list(cols["x"][s:e]), cols["side"][s:e], cols["comp"][s:e], marks[s:e]):
                a.append(cols["sid"][s + i])
                b.append(cols["sid"][s + j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("list").sortWithinPartitions("list", "sid")


def line_components(docs: DataFrame, lines: DataFrame, distinct: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(node, component) of the distinct lines that link with another one."""
    signed = lines.where("sig is not null").select("h", "sig")
    keys = signed.select("sig").mapInArrow(_all_keys, "key long")
    shared = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    members = _members(signed, shared)
    # lists that are too long for one task, each with its leader
    heavy = cut(shared.where(F.col("n") > LIST_BLOCK), "heavy")
    dense = hot = None
    first = []
    if not heavy.isEmpty():
        hot = hot_keys(heavy, "key", per_salt=LIST_BLOCK)
        tagged = cut(spread_join(members, heavy.withColumnRenamed("n", "many"), "key", hot, ["sid"], "left"), "members")
        members, dense = tagged.where("many is null").drop("many"), cut(tagged.where("many is not null").drop("many").distinct(), "dense")
        lead = dense.groupBy("key").agg(F.min(F.struct("sid", *_MARKS)).alias("lead"))
        star = spread_join(dense, lead, "key", hot, ["sid"]).where(F.col("sid") != F.col("lead.sid"))
        first = [star.where(agreeing_columns([F.col(m) for m in _MARKS], [F.col(f"lead.{m}") for m in _MARKS]) >= AGREE).select(F.col("lead.sid").alias("a"), F.col("sid").alias("b"))]
    lists = cut(_in_order(members.withColumnRenamed("key", "list")).mapInArrow(_split, "list long, sid long, other long, " + ", ".join(f"{m} long" for m in _MARKS)), "lists")
    pairs = lists.where("other is not null").select(F.col("sid").alias("a"), F.col("other").alias("b"))
    for more in first:
        pairs = pairs.unionByName(more)
    pairs = cut(pairs.distinct(), "pairs")

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = cut(ids.distinct().join(distinct.select("h", F.col("first.doc").alias("doc")), "h"), "wanted")
        return cut(_texts(docs, wanted, text_col, id_col), "texts")

    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("h")))
    links = cut(_verified(pairs, texts), "links")
    comp = components(links)
    drop(pairs, shared)

    long = lists.where("other is null").select("list", F.lit(2).alias("side"), "sid", *_MARKS)
    labelled = long.join(comp.select(F.col("node").alias("sid"), F.col("component").alias("comp")), "sid", "left").select("list", "side", "sid", F.coalesce("comp", "sid").alias("comp"), *_MARKS)
    if dense is not None:
        labelled = labelled.unionByName(dealt(dense, comp, hot, LIST_BLOCK, _MARKS))
    left = cut(_in_order(labelled).mapInArrow(_open, "list long, side int, sid long, comp long, " + ", ".join(f"{m} long" for m in _MARKS)), "open")
    if left.isEmpty():
        return comp
    if dense is not None:
        texts = texts_of(left.select(F.col("sid").alias("h")))
    rows = left.join(texts.withColumnRenamed("h", "sid"), "sid").select("list", "side", "sid", "comp", *_MARKS, "x")
    more = cut(_in_order(rows).mapInArrow(_solved, "a long, b long"), "links")
    return comp if more.isEmpty() else merged(comp, more)


def removals(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, row, gone): for each text (hashed as ``row``) of a document that loses lines, array of (line, h)."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long"), F.xxhash64(text), text)
    lines = cut(rows.mapInArrow(_signed, _LINES), "lines")
    place = F.struct(F.col("doc_id").alias("doc"), F.col("line").alias("line"))
    distinct = cut(lines.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    comp = line_components(docs, lines, distinct, text_col, id_col)
    label = distinct.join(comp.select(F.col("node").alias("h"), "component"), "h", "left").where("n > 1 or component is not null")
    label = cut(label, "label")
    kept = cut(label.where("component is not null").groupBy("component").agg(F.min("first").alias("keep"), F.count(F.lit(1)).alias("many")), "kept")
    label = cut(spread_join(label, kept.drop("many"), "component", hot_keys(kept, "component", "many"), ["h"], "left").select("h", "n", F.coalesce("keep", "first").alias("keep")), "keep")
    seen = spread_join(lines.select("doc_id", "row", "line", "h"), label.drop("n"), "h", hot_keys(label, "h"), ["doc_id", "line"])
    gone = seen.where(~(F.col("doc_id").eqNullSafe(F.col("keep.doc")) & (F.col("line") == F.col("keep.line"))))
    return gone.groupBy("doc_id", "row").agg(F.collect_set(F.struct("line", "h")).alias("gone"))


_LEFT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """``docs`` with the text that is left and how many (not blank) lines there were and are removed."""
    gone = removals(docs, text_col, id_col).select(F.col("doc_id").alias("__dedup_id"), F.col("row").alias("__dedup_row"), F.col("gone").alias("__dedup_gone"))
    own = F.col(id_col).cast("long").eqNullSafe(F.col("__dedup_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__dedup_row"))
    rows = docs.join(gone, own, "left").drop("__dedup_id", "__dedup_row")

    @F.arrow_udf(_LEFT)
    def left(texts: pa.Array, gone: pa.Array) -> pa.Array:
        done = []

        def keep() -> None:
            kind = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())])
            done.append(pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip((kept, full, less), kind, strict=True)], fields=list(kind)))

        kept, full, less, size = [], [], [], 0
        for text, cuts in zip(texts, gone, strict=True):
            whole = text.as_py()
            lines = (whole or "").split("\n")
            full.append(sum(1 for x in lines if x.strip()))
            if cuts.is_valid and whole is not None:
                at = {(c["line"], c["h"]) for c in cuts.as_py()}
                numbers = {k for k, _ in at}
                stay = [x for k, x in enumerate(lines) if k not in numbers or (k, line_hash(normal(x))) not in at]
                less.append(len(lines) - len(stay))
                whole = "\n".join(stay)
            else:
                less.append(0)
            kept.append(whole)
            size += len(whole or "")
            if size >= RUN_CHARS:
                keep()
                kept, full, less, size = [], [], [], 0
        keep()
        return pa.concat_arrays(done)

    rows = rows.withColumn("__dedup_left", left(F.col(text_col).cast("string"), F.col("__dedup_gone")))
    out = {text_col: F.col("__dedup_left.text"), lines_col: F.col("__dedup_left.n_lines"), removed_col: F.col("__dedup_left.n_removed")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(F.col("__dedup_left.text")).cast(docs.schema["n_chars"].dataType)
    return rows.withColumns(out).drop("__dedup_left", "__dedup_gone")


def op2_fuzzy_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the lines that are no copies of earlier ones."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
