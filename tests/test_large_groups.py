"""Exact medians, files with two limits, and nested projection, against brute force."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from weftline.operators.files import file_numbers
from weftline.operators.paths import project_paths
from weftline.operators.quantiles import exact_median


@pytest.mark.parametrize(("small", "ranges"), [(10_000, 1024), (40, 4), (7, 2)])
def test_medians(spark, small, ranges):
    rng = random.Random(small)
    rows = [(k, rng.choice([1.5, 2.0, float(rng.randrange(1000)), -1e300, 1e300, None, float("nan")])) for k in ("a", None) for _ in range(501)]
    rows += [("b", 7.25)] * 300 + [("c", 1.0), ("c", 2.0), ("d", None)] + [("e", float(x)) for x in range(200)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    want = {}
    for k in {r[0] for r in rows}:
        vs = [v for q, v in rows if q == k and v is not None and v == v]
        if vs:
            want[k] = statistics.median(vs)
    got = {r.k: r.m for r in exact_median(df, ["k"], F.col("v"), "m", small, ranges).collect()}
    assert got == want
    assert exact_median(df.limit(0), ["k"], F.col("v")).count() == 0
    assert exact_median(df.where("k = 'e'"), [], F.col("v"), "m", small, ranges).first().m == 99.5


def slow_files(sizes, most_rows, most_bytes):
    out, n, b, f = [], 0, 0, 0
    for s in sizes:
        if f == 0 or n == most_rows or b + s > most_bytes:
            f, n, b = f + 1, 0, 0
        n, b = n + 1, b + s
        out.append(f)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_files_with_two_limits(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 20, 120]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size int").repartition(4)
    got = {r.id: r.file for r in file_numbers(df, [F.col("id")], F.col("size"), 7, 60).collect()}
    assert [got[i] for i in range(300)] == slow_files(sizes, 7, 60)
    assert file_numbers(df.limit(0), [F.col("id")], F.col("size"), 7, 60).count() == 0


MEMBER = "k int, source string, record string, conf double, prio int, payload struct<schedule:struct<startDate:string,endDate:string>,price:double,tags:array<string>>"


def test_best_value_of_each_path_and_spans_never_inverted(spark):
    rows = [
        (1, "s1", "r1", 0.9, 1, (("2026-05-01", "2026-04-01"), None, ["x"])),  # its own end lies before its start
        (1, "s2", "r2", 0.9, 2, ((None, "2026-06-01"), 5.0, None)),
        (1, "s3", "r3", 0.8, 0, (("2026-01-01", "2026-07-01"), 6.0, ["x"])),
        (2, "s1", "r4", 0.5, 1, ((" ", "2026-01-01"), None, None)),
        (3, "s1", "r5", 0.5, 1, ((None, None), None, None)),
        (4, "s1", "r6", 0.5, 1, (("2026-05-01", "2026-04-01"), 1.0, None)),
        (5, "s1", "r7", 0.5, 1, None),
    ]
    df = spark.createDataFrame(rows, MEMBER)
    got = {r.k: r for r in project_paths(df, "k", "payload", "source", "record", "conf", "prio", spans=[("schedule.startDate", "schedule.endDate")]).collect()}
    assert set(got) == {1, 2, 4}
    one = got[1]
    assert (one.payload.schedule.startDate, one.payload.schedule.endDate, one.payload.price, one.payload.tags) == ("2026-05-01", "2026-06-01", 5.0, ["x"])
    assert one.sources == {"schedule.startDate": "s1", "schedule.endDate": "s2", "price": "s2", "tags": "s1"}
    assert one.lost == {"schedule.startDate": 1, "schedule.endDate": 1, "price": 1}
    assert got[2].payload.schedule.endDate == "2026-01-01" and got[2].payload.price is None
    assert got[4].payload.schedule.endDate is None and got[4].payload.schedule.startDate == "2026-05-01"
    assert project_paths(df.limit(0), "k", "payload", "source", "record", "conf", "prio").count() == 0


def test_members_of_a_key_meet_in_one_row_and_large_keys_are_grouped(spark):
    rng = random.Random(5)
    day = lambda: rng.choice([None, " ", "2026-01-01", "2026-01-01 10:00", "2026-02-01", "2026-03-01"])
    rows = [(rng.choice([None, 1, 2, 2, 2, 3, 4]), rng.choice("st"), f"r{n:03}", rng.choice([0.5, 0.9]), rng.choice([1, 2]), ((day(), day()), rng.choice([None, 1.0, 2.0, float("nan")]), rng.choice([None, ["x"], ["x", None]]))) for n in range(120)]
    df = spark.createDataFrame(rows, MEMBER)
    args = ("k", "payload", "source", "record", "conf", "prio")
    spans = [("schedule.startDate", "schedule.endDate")]
    found = project_paths(df, *args, spans=spans)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    shown = lambda df: sorted(str(r) for r in df.collect())
    want = shown(found)
    assert len(want) == 4  # members without a key make none
    assert shown(project_paths(df, *args, spans=spans, many=1)) == shown(project_paths(df, *args, spans=spans, many=25)) == want
