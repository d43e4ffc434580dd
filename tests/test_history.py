"""Histories merged in place: which files change, what a replay does, null keys; hashes of nested payloads."""

import hashlib
import json
import os
import random

from pyspark.sql import functions as F

from weftline.operators import observe as O
from weftline.operators.history import merge_snapshot, read_history

KIND = "id long, source string, payload string, content_hash string"


def digests(path):
    out = {}
    for top, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                with open(f"{top}/{n}", "rb") as f:
                    out.setdefault(os.path.basename(top), []).append(hashlib.md5(f.read()).hexdigest())
    return out


def snapshot(spark, ids, source="a", mark="h"):
    return spark.createDataFrame([(i, source, f"p{i}", f"{mark}{i}") for i in ids], KIND)


def test_only_touched_parts_are_written_and_a_replay_writes_the_same(spark, tmp_path):
    path = str(tmp_path / "h")
    merge_snapshot(path, snapshot(spark, range(60)).unionByName(snapshot(spark, range(100, 160), "b")), F.lit("d1"), buckets=4)
    before = digests(path)
    assert len(before) == 8 and all(len(v) == 1 for v in before.values())
    batch = snapshot(spark, [*range(50), 200], "a", "x")
    changes = {r.id: r.change for r in merge_snapshot(path, batch, F.lit("d2"), buckets=4).collect()}
    assert changes == {i: "changed" for i in range(50)} | {i: "disappeared" for i in range(50, 60)} | {200: "added"}
    after = digests(path)
    assert {k for k in after if after[k] != before[k]} == {k for k in after if k.startswith("part=a-")}
    rows = sorted(map(tuple, read_history(spark, path).collect()))
    merge_snapshot(path, batch, F.lit("d2"), buckets=4)
    assert sorted(map(tuple, read_history(spark, path).collect())) == rows and digests(path) == after
    one = merge_snapshot(path, snapshot(spark, [7], "a", "y"), F.lit("d3"), buckets=4, whole=False)
    assert {r.id: r.change for r in one.where("change <> 'untouched'").collect()} == {7: "changed"}
    last = digests(path)
    assert len([k for k in last if last[k] != after[k]]) == 1
    gone = {r.id: r.disappeared for r in read_history(spark, path).collect()}
    assert gone[55] == "d2" and {i for i in gone if gone[i]} == set(range(50, 60)) and gone[7] is None and gone[100] is None


def test_null_keys_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "h")
    assert merge_snapshot(path, snapshot(spark, []), F.lit("d0")).count() == 0
    rows = [(None, "a", "p", "h"), (1, None, "p", "h")]
    assert [tuple(r) for r in merge_snapshot(path, spark.createDataFrame(rows, KIND), F.lit("d1")).collect()] == [(1, "added")]
    old = spark.createDataFrame([(None, "p", "h", "d0", "d0", "d0", None)], "id long, payload string, content_hash string, first_observed string, last_verified string, last_changed string, disappeared string")
    new = spark.createDataFrame([(None, "p", "h"), (3, "q", "h3")], "id long, payload string, content_hash string")
    assert [(r.id, r.change) for r in O.snapshot_merge(new, old, "id", F.lit("d1")).collect()] == [(3, "added")]


def test_hashes_of_nested_payloads(spark):
    same = ['{"a": 1, "b": {"x": [1, {"p": 1, "q": null}], "y": "é\\""}}', '{"b":{"y":"é\\"","x":[1,{"p":1}]},"a":1,"none":null}', '{"a":1,"b":{"x":[1,{"at":5,"p":1}],"y":"é\\"","at":[]},"at":"now"}']
    other = ['{"a": 1, "b": {"x": [{"p": 1}, 1], "y": "é\\""}}', '{"a": "1"}', "[]", "[null]", "no json", "", "7", None]
    df = spark.createDataFrame([(s,) for s in same + other], "j string")
    got = [r[0] for r in df.select(O.nested_hash(F.col("j"), volatile=("at",))).collect()]
    assert len(set(got[:3])) == 1 and len(set(got)) == 1 + len(other) and got[-1] is None
    assert got[0] == hashlib.sha256('{"a":1,"b":{"x":[1,{"p":1}],"y":"é\\""}}'.encode()).hexdigest()
    leaves = lambda depth: df.select(O.nested_hash(F.col("j"), depth=depth))._jdf.queryExecution().analyzed().expressions().apply(0).collectLeaves().size()
    assert leaves(4) - leaves(2) == leaves(6) - leaves(4)


def test_shallow_payloads_are_settled_in_their_text_and_all_as_by_hand(spark):
    rng = random.Random(3)
    words = ["at", "a", "b,c", "x\":null,", "{", "]\\", ":null", "é", "\U0001f600", "", ""]

    def value(left):
        kind = rng.randrange(7 if left else 4)
        if kind > 4:
            return {rng.choice(words): value(left - 1) for _ in range(rng.randrange(5))}
        return [None, rng.randrange(-5, 99), rng.choice(words), True, [value(left - 1) for _ in range(rng.randrange(4))] if left else None][kind]

    def canon(v, left):
        if isinstance(v, dict):
            kept = sorted(v.items(), key=lambda x: x[0].encode() if left else x[0].encode("utf-16-be"))
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canon(x, max(left - 1, 0))}" for k, x in kept if not left or (x is not None and k not in ("at", "b,c"))) + "}"
        if isinstance(v, list):
            return "[" + ",".join(canon(x, max(left - 1, 0)) for x in v) + "]"
        return json.dumps(v, ensure_ascii=False)

    made = [value(5) for _ in range(600)] + [{"a": {"at": [1], "b": None}}, {"at": 1}, {"a": None, "at": "x", "b": 1}, {"b": 1, "at": {}, "é": None}]
    df = spark.createDataFrame([(n, json.dumps(v, ensure_ascii=n % 2 > 0)) for n, v in enumerate(made)], "n int, j string").repartition(4)
    for depth in (3, 6):
        found = df.select("n", O.nested_hash(F.col("j"), volatile=("at", "b,c"), depth=depth).alias("h"))
        assert "regexp_replace" in found._jdf.queryExecution().optimizedPlan().toString()
        got = {r.n: r.h for r in found.collect()}
        assert [n for n, v in enumerate(made) if got[n] != hashlib.sha256(canon(v, depth).encode()).hexdigest()] == []
