import numpy as np
import pytest

from weftline.llm import ann, topk_join


def write(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")


def rows_of(n, seed, hot=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8)).astype(np.float32) * rng.integers(1, 4, (n, 1))
    x[:hot] = x[0]
    rows = [(k, [float(v) for v in x[k]], 0) for k in range(n)]
    bad = [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 8, 0), (n + 3, [float("nan")] * 8, 0), (n + 4, [1.0] * 7 + [None], 0), (None, [9.0] * 8, 0), (n + 5, [float("inf")] * 8, 0)]
    return rows + bad + rows[:2]


def vectors(rows, zero):
    out = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = np.array(v, np.float32).astype(np.float64)
    return out


@pytest.mark.parametrize("hot", [0, 60])
def test_topk_equals_brute_force(spark, tmp_path, hot):
    rows = rows_of(160, 1, hot)
    write(spark, tmp_path, rows)
    got = sorted(map(tuple, topk_join.op7_exact_topk(spark, str(tmp_path)).collect()))
    data = {i: np.floor(256 * v).astype(np.int64) for i, v in vectors(rows, True).items()}
    want = []
    for q in data:
        if q % 50 == 0:
            best = sorted(((-int(data[q] @ v), i) for i, v in data.items() if i != q))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_topk_bounds_prune_but_lose_nothing(spark, monkeypatch):
    """Far clusters, small blocks: cells are skipped and answers stay exact."""
    monkeypatch.setattr(topk_join, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 4)) + rng.integers(0, 3, (300, 1)) * 50).round().astype(int) * 3
    df = spark.createDataFrame([(k, [int(v) for v in x[k]]) for k in range(300)], "id long, vec array<long>")
    got = sorted(map(tuple, topk_join.topk_join(df, df.id % 7 == 0, 4).collect()))
    want = []
    for q in range(0, 300, 7):
        best = sorted(((-int(x[q] @ x[i]), i) for i in range(300) if i != q))[:4]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("hot", [0, 80])
def test_forest_recall_and_exact_scores(spark, tmp_path, hot):
    rows = rows_of(400, 2, hot)
    write(spark, tmp_path, rows)
    got = ann.op5_ann_forest(spark, str(tmp_path)).toPandas()
    data = vectors(rows, False)
    hits = total = 0
    for q in data:
        if q % 20 == 0:
            mine = got[got.query_id == q].sort_values("rank")
            best = sorted(((-float(data[q] @ v), i) for i, v in data.items() if i != q))[:20]
            hits += len({i for _, i in best} & set(mine.vec_id))
            total += 20
            assert list(mine["rank"]) == list(range(1, 21)) and q not in set(mine.vec_id)
            assert np.allclose(mine.score, [data[q] @ data[i] for i in mine.vec_id], atol=1e-9)
            assert list(mine.score) == sorted(mine.score, reverse=True)
    assert hits / total >= 0.9


def test_small_and_empty_tables(spark, tmp_path):
    write(spark, tmp_path / "a", [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0)])
    assert [tuple(r) for r in topk_join.op7_exact_topk(spark, str(tmp_path / "a")).collect()] == [(0, 1, 1, 32768)]
    assert [tuple(r) for r in ann.op5_ann_forest(spark, str(tmp_path / "a")).collect()] == [(0, 1, 1, 0.5)]
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert topk_join.op7_exact_topk(spark, str(tmp_path / "b")).count() == 0
    assert ann.op5_ann_forest(spark, str(tmp_path / "b")).count() == 0


def test_vectors_of_three_lengths_are_searched_among_their_own(spark, tmp_path):
    rows = [(k, [1.0 + k, 2.0], 0) for k in range(4)] + [(k, [1.0, 2.0, k / 50], 0) for k in (50, 100, 101)] + [(200, [1.0], 0)]
    write(spark, tmp_path, rows)
    want = {0: [3, 2, 1], 50: [101, 100], 100: [101, 50]}
    for found, every in ((topk_join.op7_exact_topk, 50), (ann.op5_ann_forest, 20)):
        got = {}
        for r in found(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == {q: w for q, w in want.items() if q % every == 0}


def test_too_many_lengths_are_named(spark):
    df = spark.createDataFrame([(k, [1.0] * (k + 1)) for k in range(70)], "id long, vec array<double>")
    with pytest.raises(ValueError, match="more than 64 lengths"):
        ann.search(df, df.id % 20 == 0)


def test_a_prefix_with_most_queries_is_dealt_out(spark, monkeypatch):
    """Nearly equal vectors share their prefixes: blocks of queries meet blocks of vectors."""
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(8)
    x = 1 + rng.normal(size=(300, 6)) * 0.01
    df = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(300)], "id long, vec array<double>")
    got = ann.search(df, df.id % 2 == 0, k=5).toPandas()
    assert got.groupby("query_id").size().to_dict() == {q: 5 for q in range(0, 300, 2)}
    hits = 0
    for q, part in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:5]) & set(part.id))
    assert hits >= 0.9 * 5 * 150


def test_topk_of_large_and_nearly_equal_vectors(spark, monkeypatch):
    """Norms of a million, differences of one: bounds must leave room for rounding."""
    monkeypatch.setattr(topk_join, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = 1_000_000 + rng.integers(0, 3, (240, 6)) + rng.integers(0, 3, (240, 1)) * 40
    df = spark.createDataFrame([(k, [int(v) for v in x[k]], "c") for k in range(240)], "id long, vec array<long>, score string")
    got = sorted(map(tuple, topk_join.topk_join(df, df.id % 7 == 0, 4).collect()))
    want = []
    for q in range(0, 240, 7):
        best = sorted(((-int(x[q] @ x[i]), i) for i in range(240) if i != q))[:4]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_prefix_lengths():
    a = np.array([0b1010 << 28, 0b1011 << 28, 0], np.uint32)
    assert list(ann.common(a, np.uint32(0b1010 << 28))) == [32, 3, 0]
    assert ann.level_ranges(np.sort(a), np.uint32(0b1010 << 28), 3) == (1, 3)


def served(spark, x):
    """The rows for each query, all others in reach: every row has its exact score."""
    df = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(len(x))], "id long, vec array<float>")
    got = ann.search(df, df.id % 20 == 0).toPandas()
    x = x.astype(np.float32).astype(np.float64)
    assert np.allclose(got.score, [x[q] @ x[i] for q, i in zip(got.query_id, got.id, strict=True)])
    assert not got.duplicated(["query_id", "id"]).any() and not (got.query_id == got.id).any()
    return got.groupby("query_id").size().to_dict()


def test_scattered_queries_beside_tight_clusters_get_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(5)

    def directions(n):
        x = rng.normal(size=(n, 16))
        return x / np.linalg.norm(x, axis=1)[:, None]

    x = directions(12)[rng.integers(0, 12, 1200)] + rng.normal(size=(1200, 16)) * 0.001
    x[[0, 600]] = directions(2)  # far from all clusters
    assert served(spark, x) == {q: 20 for q in range(0, 1200, 20)}


def test_one_long_vector_takes_no_rows_from_queries(spark):
    x = np.random.default_rng(1).normal(size=(2000, 8))
    x[7] *= 1000
    assert served(spark, x) == {q: 20 for q in range(0, 2000, 20)}
