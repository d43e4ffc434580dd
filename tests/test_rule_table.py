"""Rules as data, page dates and report parts, against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import page_dates as D
from weftline.operators import reports as R
from weftline.operators import rules as Ru
from weftline.operators.rule_table import filed, label_texts, needed_literals


def test_literals_that_every_match_needs():
    assert needed_literals("abc") == [["abc"]]
    assert needed_literals("(?:foo|Bar)x+baz?") == [["bar", "foo"], ["x"], ["ba"]]
    assert needed_literals("a|b*") == [] and needed_literals("[ab]+") == [] and needed_literals("(") == []
    assert needed_literals("ab[0-9]{2}cd") == [["ab"], ["cd"]]


RULES = ["yoga", "瑜珈|yoga", "泳(?!裝)", "^[0-9]+$", "a.c", "(foo|ba[rz])+", "İ", "x{0,2}y", "\\bend$", "no such thing at all"]
TEXTS = ["YOGA class", "瑜珈", "泳裝", "泳池", "2024", "abc", "xFOOx BAZ", "", None, "y", "the END", "ab", "c", "a" * 50_000 + "bc"]


def test_labels_equal_trying_every_rule(spark):
    texts = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "yoga", "x")], "id long, text string, ord string").repartition(3)
    rules = spark.createDataFrame([(k, p) for k, p in enumerate(RULES)] + [(99, None)], "ord long, pattern string")
    got = {(r.id, r.ord) for r in label_texts(texts, rules).collect()}
    assert got == {(i, k) for i, t in enumerate(TEXTS) if t is not None for k, p in enumerate(RULES) if re.search(p, t, re.I)}
    assert label_texts(texts, rules.limit(0)).count() == 0 and label_texts(texts.limit(0), rules).count() == 0


def test_a_plan_does_not_grow_with_the_rules(spark):
    texts = spark.createDataFrame([(1, "rule00077 of many")], "id long, text string")
    sizes = []
    for n in (10, 10_000):
        rules = spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("RULE"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("pattern"))
        found = label_texts(texts, rules)
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString().split("\n")))
    assert sizes[0] == sizes[1] and [r.ord for r in found.collect()] == [77]
    with pytest.raises(ValueError, match="no literal"):
        label_texts(texts, spark.range(100).select(F.col("id").alias("ord"), F.lit("[a-z]+").alias("pattern")))


def test_no_table_of_rules_or_texts_is_broadcast_and_short_literals_are_filed_whole(spark):
    texts = spark.range(200).select("id", F.concat(F.lit("no "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("text"))
    rules = spark.range(100, 200).select(F.col("id").alias("ord"), F.concat(F.lit("NO 0*1"), F.col("id").cast("string"), F.lit("$")).alias("pattern"))
    found = label_texts(texts.withColumn("text", F.concat(F.lit("no 00001"), F.col("id").cast("string"))), rules)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(k, k) for k in range(100, 200)]
    filing = filed(spark.createDataFrame([(1, "12345"), (2, "123456789")], "ord long, pattern string"))
    assert sorted((r.ord, r.run) for r in filing.collect()) == [(1, "12345"), (2, "12345678"), (2, "23456789")]


def test_labels_and_classes_read_patterns_as_sql_does(spark):
    import duckdb

    texts = ["modèles", "les", "idées\n", "the\n", "LEſ amis", "to\u212aen", "TOKEN", "naïve", "a\u2028b", "a\nb", "Straße s", "ı", "sSk$", "_les", "les\u0301", None]
    rules = [r"\b(the|der|les)\b", "token", "the$", "a.b", r"[s$]\$|\bi", "(?:^|x)e?\\bve", "(?<n>na)", "^sſ?S", "İ|ß"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: (r.found, r.kind) for r in df.select("k", Ru.labels(F.col("t"), F.col("t"), [{"name": p, "match": p} for p in rules if "?<" not in p]).alias("found"), Ru.classify(F.col("t"), [(p, p) for p in rules if "?<" not in p], "none").alias("kind")).collect()}
    con = duckdb.connect()
    hit = lambda p, t: t is not None and con.execute("select regexp_matches(?, ?)", [t, p]).fetchone()[0]
    for k, t in enumerate(texts):
        plain = [p for p in rules if "?<" not in p]
        assert got[k] == ([p for p in plain if hit("(?i)" + p, t)], next((p for p in plain if hit(p, t)), "none")), t
    assert df.where(Ru.fits(F.col("t"), rules[6])).count() == 1


def test_page_dates_by_change_and_in_full(spark):
    kind = "page string, item int, hash string"
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("c", 3, "z"), ("d", 4, None), ("e", 5, "q")], kind)
    new = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 3, "z2"), ("d", 4, None), ("f", 6, "n"), ("g", 1, "x")], kind)
    dates = spark.createDataFrame([(p, "d1") for p in "abcde"], "page string, lastmod string")
    want = {"a": "d2", "b": "d1", "c": "d2", "d": "d1", "f": "d2", "g": "d2"}
    changes = D.member_changes(old, new)
    assert {r.page: r.lastmod for r in D.apply_changes(dates, new, changes, F.lit("d2")).collect()} == want
    assert {r.page: r.lastmod for r in D.full_dates(old, new, dates, F.lit("d2")).collect()} == want
    assert {r.page for r in D.item_changes(new, spark.createDataFrame([(1,)], "item int")).collect()} == {"a", "b", "g"}


def test_report_parts(spark):
    lines = spark.createDataFrame([(1, "﻿台北市甲路1號,25.0,121.5,x"), (2, "臺北市甲路１號,25.5,121.5"), (3, "臺北市乙路2號,nan,121"), (4, ""), (5, None), (6, ",1,2")], "at int, line string")
    assert [tuple(r) for r in R.geocode_lookup(lines, "line", "at").collect()] == [("臺北市甲路1號", 25.5, 121.5)]
    rows = spark.createDataFrame([("a",), ("b",), ("b",), ("",), (None,), ("c",)], "key string")
    assert [tuple(r) for r in R.unresolved(rows, "key", rows.where("key = 'a'")).collect()] == [("b", 2), ("c", 1)]
    t = spark.createDataFrame([("k", 1, "器械皮拉提斯"), ("k", 2, "器械皮拉提斯"), ("k", 3, "皮拉提斯"), ("z", 4, "a.b"), ("z", 5, None)], "k string, at int, title string").withColumn("word", F.when(F.col("k") == "k", "皮拉提斯").otherwise("b"))
    assert [tuple(r) for r in R.dominant_prefix(t, ["k"], "title", "word", "at").collect()] == [("k", "器械", 2, 3)]
    pages = spark.createDataFrame([("p", True), ("q", True), ("r", False), ("s", None)], "path string, paused boolean")
    assert sorted(r.path for r in R.whitelisted(pages, F.col("path"), pages.where("path = 'p'"), F.col("paused")).collect()) == ["p", "r", "s"]
