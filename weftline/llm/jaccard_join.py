"""N-gram Jaccard join: exact links between shingle sets, by set-relation skipping.

Two documents link when ``100 * |A and B| >= percent * |A or B|`` for their sets
of distinct word shingles.  The steps:

1. Equal sets collapse into one (by a 64-bit digest of the whole set).
2. Every set keeps a prefix of its rarest shingles.  Rarity follows token loads
   counted over all documents; any one order is exact, a rare-first order makes
   short lists.  Two sets that link share a prefix shingle.
3. *Index-level skipping*: the list of a shingle holds (size, position) of its sets in
   blocks of equal size, in which positions rise.  A set touches only the blocks of
   sizes within the ratio, and each only up to the last position from which the overlap
   that a link needs can still be reached; what lies behind is skipped over.
4. *Answer-level skipping*: in long lists, the distances of one set to all others are
   kept, and the answers of a set close to it are derived from them: only rows within
   the kept distance plus the difference of the two are looked at.  Rounds first compare
   all sets with a few leaders; whatever links takes over its leader's component, and
   the last round compares only pairs that still lie in different components.
5. Candidates are first held against 1,024-bit set bitmaps (a lower bound of the
   difference, so no link is lost) and then verified on whole sets of 64-bit shingle
   hashes.  Long lists carry the bitmaps, so only likely pairs leave their tasks.

Lists of shingles that load more than one block meet their leader undivided and are
then dealt out by pairs of blocks, but for blocks that the leader has joined; so no
task holds more than two blocks of a list, whatever its length.  Joins spread sets that
very many documents share and leaders of very many pairs.

Token loads are counted in 2**22 buckets, so at many billions of shingles their order
says little and lists grow longer; results stay exact.

Edge cases: a document without words (or null) has no set, zero shingles and
its own id as component; with fewer words than ``n`` the whole sequence is its
one shingle.  Repeated rows have equal sets and so link.  Rows with a null id take the
component of the rows with an equal set that have one, else null.  Texts of any length
are taken whole.  An empty table gives an empty result.  Other columns of the input are
ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from ..operators.skew import hot_keys, spread_join
from .lists import LIST_BLOCK, WORDS, dealt, packed_at, settled, split_lists
from .scratch import cut, table
from .sketch import IdFilter, TokenLoads, differing_bits, id_filter, token_loads

def _sets(col: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, set members ascending back to back, bounds)."""
    for first, end, raw, offsets in hashing.runs(col):
        words, bounds = hashing.words(raw.lower(), offsets)
        values, owner = hashing.shingles(words, bounds, n)
        yield first, end, *hashing.distinct_sets(values, owner, end - first)


def _digests(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A digest of each set; of an empty one 0."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(hashing.mix(values ^ np.uint64(0x51ED270B0A1F39C7)), out=sums[1:])
    sizes = np.diff(bounds)
    out = hashing.mix(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64))
    out[sizes == 0] = 0
    return out.view(np.int64)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    ends = np.cumsum([0] + [len(a) for a in arrays])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def shingle_sets(docs: DataFrame, n: int, percent: int, loads: TokenLoads, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, size, sid, tokens, blocks, bits): each document's set in short."""
    spread, shift = docs.sparkSession.sparkContext.broadcast(loads.levels), int(loads.shift)
    typical = loads.typical

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = spread.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, end, values, bounds in _sets(texts, n):
                sizes, sids = np.diff(bounds), _digests(values, bounds)
                level = levels[(values >> np.uint64(shift)).astype(np.int64)]
                blocks = np.maximum(1, np.expm1(level / 8.0 * np.log(2)) / LIST_BLOCK - 4 * typical / LIST_BLOCK).astype(np.int32)
                owner = np.repeat(np.arange(end - first), sizes)
                order = np.lexsort((values, level, owner))
                marks = np.zeros((end - first, WORDS * 64), bool)
                marks[owner, (values & np.uint64(WORDS * 64 - 1)).astype(np.int64)] = True
                bits = np.packbits(marks, axis=1, bitorder="little").view(np.int64)
                keep = np.where(sizes > 0, sizes + (-percent * sizes) // 100 + 1, 0)
                picks = [order[b : b + k] for b, k in zip(bounds[:-1], keep, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, end - first),
                        pa.array(sizes.astype(np.int32)),
                        pa.array(sids),
                        _lists([values[p].view(np.int64) for p in picks], pa.int64()),
                        _lists([blocks[p] for p in picks], pa.int32()),
                        pa.FixedSizeListArray.from_arrays(pa.array(bits.reshape(-1)), WORDS).cast(pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "size", "sid", "tokens", "blocks", "bits"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(of, "doc_id long, size int, sid long, tokens array<long>, blocks array<int>, bits array<long>")


def _packed(docs: DataFrame, wanted: DataFrame, n: int, text_col: str, id_col: str) -> DataFrame:
    """(sid, members): whole sets of the wanted (sid, doc_id), 8 bytes a member, ascending."""
    words = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "doc_id").words)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = IdFilter(words.value)
        for batch in batches:
            ok = ids.may_hold(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            part = batch.filter(pa.array(ok))
            for first, end, values, bounds in _sets(part.column(1), n):
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(first, end - first),
                        pa.array(_digests(values, bounds)),
                        pa.array([values[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "sid", "members"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).where("doc_id is not null").mapInArrow(of, "doc_id long, sid long, members binary")
    return rows.join(wanted, ["doc_id", "sid"]).select("sid", "members").dropDuplicates(["sid"])


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets link.

    A leader's set comes once before the sets it is held against; very many of those
    are spread over several copies of the leader.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            ok = []
            for b, x in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = np.frombuffer(x.as_py(), np.uint64)
                if b is None:
                    head = own
                    ok.append(False)
                    continue
                both = len(np.intersect1d(head, own, assume_unique=True))
                ok.append(100 * both >= percent * (len(head) + len(own) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    hot = hot_keys(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a")
    if hot is None:
        pairs = pairs.select("a", "b", F.lit(0).alias("part"))
    else:
        pairs = pairs.join(F.broadcast(hot), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("__salts")), F.lit(0)).cast("int").alias("part"))
    others = pairs.join(full.select(F.col("sid").alias("b"), "members"), "b").select("a", "part", "b", "members")
    heads = pairs.select("a", "part").distinct().join(full.select(F.col("sid").alias("a"), "members"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "members")
    rows = heads.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(check, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")

    def tokens(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, values, _ in _sets(batch.column(0), n):
            yield values

    loads = token_loads(docs.select(F.col(text_col).cast("string").alias("t")), ["t"], tokens)
    sets = cut(shingle_sets(docs, n, percent, loads, text_col, id_col), "sets")
    reps = cut(sets.where("size > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "reps")
    one = sets.join(reps.drop("n"), ["sid", "doc_id"])

    short = cut(one.select("sid", "doc_id", "size", "bits").dropDuplicates(["sid"]), "short")
    post = one.select("sid", "size", F.posexplode(F.arrays_zip("tokens", "blocks")).alias("pos", "t"))
    post = post.select("sid", "size", "pos", F.col("t.tokens").alias("key"), F.col("t.blocks").alias("blocks"))
    at = packed_at(F.col("size"), F.col("pos"), F.lit(2))
    lists = split_lists(post.where("blocks = 1").select(F.col("key").alias("list"), at.alias("at"), "sid"), percent)
    marked = short.select("sid", F.to_binary(F.array_join(F.transform("bits", lambda v: F.lpad(F.hex(v), 16, "0")), ""), F.lit("hex")).alias("marks"))

    # lists that are too long for one task, as they are against one leader each
    dense = cut(post.where("blocks > 1").drop("blocks").distinct(), "dense")
    stars, hot, deal = None, None, None
    if not dense.isEmpty():
        hot = hot_keys(dense.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", per_salt=LIST_BLOCK)
        lead = dense.groupBy("key").agg(F.min("sid").alias("lead"))
        stars = spread_join(dense, lead, "key", hot, ["sid"]).where("sid <> lead").select(F.col("lead").alias("a"), F.col("sid").alias("b"))

        def deal(comp: DataFrame) -> DataFrame:
            cells = dealt(dense, comp, hot, LIST_BLOCK, ["size", "pos"])
            return cells.select("list", packed_at(F.col("size"), F.col("pos"), F.col("side")).alias("at"), "sid", "comp").join(marked, "sid")

    x = short.select(F.col("sid").alias("a"), F.col("size").alias("na"), F.col("bits").alias("xa"))
    y = short.select(F.col("sid").alias("b"), F.col("size").alias("nb"), F.col("bits").alias("xb"))
    total = F.col("na") + F.col("nb")
    most = total - 2 * F.ceil(percent * total / F.lit(100 + percent))
    pairs = lists.where("other is not null").select(F.col("sid").alias("a"), F.col("other").alias("b"))
    pairs = (pairs if stars is None else pairs.unionByName(stars)).distinct()
    pairs = pairs.join(y, "b")
    leaders = hot_keys(stars.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a") if stars is not None else None
    pairs = spread_join(pairs, x, "a", leaders, ["b"]).where(differing_bits(F.col("xa"), F.col("xb")) <= most).select("a", "b")
    long = cut(lists.where("other is null").select("list", "at", "sid").join(marked, "sid"), "long")

    def verify(todo: DataFrame) -> DataFrame:
        ends = todo.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        wanted = cut(ends.join(short.select("sid", "doc_id"), "sid"), "wanted")
        return _verified(todo, cut(_packed(docs, wanted, n, text_col, id_col), "full"), percent)

    comp = settled(pairs, long, percent, verify, deal)
    own = sets.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "sid")
    if comp is None:
        label = reps.select("sid", F.col("doc_id").alias("component_id"), "n")
    else:
        root = cut(reps.join(comp.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid")), "root")
        names = cut(root.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("sets")), "names")
        label = cut(spread_join(root, names.drop("sets"), "component", hot_keys(names, "component", "sets"), ["sid"]).select("sid", "component_id", "n"), "labels")
    full = own.where("n_shingles > 0")
    full = spread_join(full, label.drop("n"), "sid", hot_keys(label, "sid"), ["doc_id"], "left").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets link at 90 percent."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
