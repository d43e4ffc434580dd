import random

from pyspark.sql import functions as F

from weftline.operators import skew
from weftline.operators.graph import components, merged


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in [100, *range(200, 230)]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_grow_with_the_logarithm(spark):
    rounds = []
    chain = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(chain, report=rounds)
    assert got.agg(F.max("component")).first()[0] == 0 and got.count() == 10_001
    assert len(rounds) <= 20


def test_hot_nodes_are_spread(spark, monkeypatch):
    monkeypatch.setattr(skew, "PER_SALT", 16)
    rng = random.Random(2)
    edges = [(0, k) for k in range(1, 6000)] + [(rng.randrange(7000, 7100), rng.randrange(7100, 7200)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {n: n for e in edges for n in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in up}


def test_merging_further_links(spark):
    kind = "a long, b long"
    comp = components(spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21)], kind))
    got = {r.node: r.component for r in merged(comp, spark.createDataFrame([(3, 11), (30, 31), (31, 20), (1, 3)], kind)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 20, 31: 20}
    assert {r.node: r.component for r in merged(comp, spark.createDataFrame([], kind)).collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, 21: 20}


def test_spread_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "PER_SALT", 3)
    big = spark.createDataFrame([(k, k % 7 if k > 30 else 1) for k in range(60)] + [(99, None)], "v long, key long")
    small = spark.createDataFrame([(1, "a"), (2, "b")], "key long, x string")
    hot = skew.hot_keys(big.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    assert hot.count() > 0
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(small, "key", how).collect()))
        assert sorted(map(str, skew.spread_join(big, small, "key", hot, ["v"], how).collect())) == want
