import numpy as np
import pytest

from weftline.llm import packing as m


@pytest.mark.parametrize("seed", range(6))
def test_every_piece_takes_the_tightest_compatible_bin(seed):
    rng = np.random.default_rng(seed)
    n, room = 300, 50
    length = np.sort(rng.integers(1, room + 1, n))[::-1].copy()
    source = rng.integers(0, 4, n) * (rng.random(n) < 0.6)
    cluster = rng.integers(0, 40, n)
    got = m.pack(length, source, cluster, room, 2)
    bins = {}
    for i in range(n):
        left = {k: room - sum(length[j] for j in v) for k, v in bins.items()}
        fits = [left[k] for k, v in bins.items() if left[k] >= length[i] and sum(source[j] == source[i] for j in v) < 2 and all(cluster[j] != cluster[i] for j in v)]
        if fits:
            assert got[i] in bins and left[got[i]] == min(fits)
            assert all(cluster[j] != cluster[i] for j in bins[got[i]])
        else:
            assert got[i] not in bins
        bins.setdefault(got[i], []).append(i)


def test_all_tokens_are_placed_once(spark):
    rows = [(k, f"s{k % 3}", "w " * (k * 7 % 90)) for k in range(60)]
    rows += [(100, None, None), (101, "s0", ""), (5, "s2", "w " * 35), (5, "s2", "w " * 35), (200, "s1", "x y " * 500)]
    docs = m.measured(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    out = m.pack_documents(docs, capacity=64, shard=16).toPandas()
    want = sorted((i, len((t or "").split())) for i, _, t in rows)
    got = out.assign(n=out.stop - out.start).groupby(["doc_id", "copy"]).n.sum().reset_index()
    assert sorted(zip(got.doc_id, got.n)) == want
    used = out.assign(n=out.stop - out.start).dropna(subset=["bin"]).groupby("bin").n.sum()
    assert used.max() <= 64
    copies = out[(out.doc_id == 5)]
    assert copies.bin.nunique() == len(copies) == 3
    assert out[out.doc_id.isin([100, 101])].bin.isna().all()


def test_null_clusters_conflict_with_nothing_and_long_texts_fill_bins(spark):
    rows = [(k, "a" if k % 2 else "b", 30, None, "mine", 7) for k in range(4)] + [(10, "c", 30, 0, "mine", 7), (11, "d", 30, 0, "mine", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, cluster long, bin string, piece int")
    out = m.pack_documents(docs, capacity=60).toPandas()
    bins = {r.doc_id: r.bin for r in out.itertuples()}
    assert len({bins[k] for k in range(4)}) == 2 and bins[10] != bins[11]  # nulls fill two bins, equal clusters stay apart
    long = m.measured(spark.createDataFrame([(1, "s", "w " * 600_000)], "doc_id long, source string, text string"))
    out = m.pack_documents(long).toPandas()
    assert (out.stop - out.start).sum() == 600_000 and out.bin.nunique() == len(out) == -(-600_000 // m.CAPACITY)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert m.pack_documents(m.measured(docs)).count() == 0
