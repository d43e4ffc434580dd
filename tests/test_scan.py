"""Running state over ranges against a walk over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import windows as V
from weftline.operators.scan import running

KINDS = ("last", "first", "previous", "sum", "max", "min")


def slow(rows):
    out = {}
    state = {}
    for k, t, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        s = state.setdefault(k, dict.fromkeys(KINDS))
        row = {"previous": s["previous"]}
        s["previous"] = v
        if v is not None:
            s |= {"last": v, "first": v if s["first"] is None else s["first"], "sum": (s["sum"] or 0) + v, "max": v if s["max"] is None else max(v, s["max"]), "min": v if s["min"] is None else min(v, s["min"])}
        out[k, t] = {n: s[n] for n in KINDS if n != "previous"} | row
    return out


@pytest.mark.parametrize("keys", [["a"], [None, "a", "b", "c", "d"]])
def test_equals_a_walk(spark, keys):
    rng = random.Random(len(keys))
    rows = [(rng.choice(keys), t, rng.choice([None, None, rng.randrange(-9, 9)])) for t in range(700)]
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(3)
    got = running(df, ["k"], ["t"], {f"{n}_v": (n, F.col("v")) for n in KINDS}, ranges=13).collect()
    want = slow(rows)
    assert len(got) == len(rows) and {(r.k, r.t): {n: r[f"{n}_v"] for n in KINDS} for r in got} == want


def test_no_values_no_rows_no_keys(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None)], "t int, v int")
    assert [(r.t, r.x) for r in running(df, [], [F.desc("t")], {"x": ("last", F.col("v"))}).orderBy("t").collect()] == [(1, 5), (2, 5), (3, None)]
    assert running(df.limit(0), [], ["t"], {"x": ("sum", F.col("v"))}).count() == 0
    with pytest.raises(ValueError, match="mean"):
        running(df, [], ["t"], {"x": ("mean", F.col("v"))})


def test_no_task_holds_a_group(spark):
    df = spark.range(2000).withColumn("k", F.lit(1))
    made = running(df, ["k"], ["id"], {"s": ("sum", F.col("id"))}, ranges=16)
    assert made.where("s <> id * (id + 1) / 2").count() == 0
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(__range" in plan


def test_large_k_in_parts(spark):
    df = spark.range(3000).withColumn("k", F.when(F.col("id") % 10 == 0, 2).otherwise(1))
    order = [F.desc(F.col("id") % 100), F.asc("id")]
    got = V.top_k_spread(df, ["k"], order, 40, "nth", by=["id"], per_task=150)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, V.top_k(df, ["k"], order, 40, "nth").collect()))
