import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import quality_rules as q


def slow(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def texts(n=300, seed=3):
    rng = random.Random(seed)
    pool = ["a", "b", "é", "日本", "x#", "|", "$$%", "Word", "😀!", "<b>", " z"]
    gaps = [" ", "  ", "\n", "\t", "\n\n", " \n", "\r\n", "\x0b", "\x0c"]
    out = [None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "x\nx\nx ", "\n", "a\n \na", "same words here same words here same"]
    return out + ["".join(rng.choice(pool) + rng.choice(gaps) for _ in range(rng.randrange(0, 90))) for _ in range(n)]


def labelled(n=900, seed=5):
    """Good prose, shouting, symbol noise, and tables that are noise only where they are long."""
    rng = random.Random(seed)
    words = [a + b + c for a in ("ri", "sta", "mo", "tre") for b in ("ver", "nd", "un", "l") for c in ("s", "ing", "ed", "")]
    rows = []
    for k in range(n):
        said = [rng.choice(words) for _ in range(rng.randrange(60, 120))]
        if k % 6 == 0:
            said = [w.upper() for w in said]
        elif k % 6 == 1:
            said = [w + rng.choice(["$$$", "###"]) for w in said]
        rows.append((k, " ".join(said), int(k % 6 > 1)))
    return rows


def test_counts_equal_brute_force(spark):
    all_texts = texts()
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in q.judge(docs, []).collect()}
    for i, t in enumerate(all_texts):
        r = got[i]
        want = slow(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, repr(t)
        assert r.kept == (not want[-1]) and r.rule is None


def test_very_long_text_and_columns_that_clash(spark):
    t = "the old house\n" * 100_000
    docs = spark.createDataFrame([(1, t, "mine", 5), (None, None, "x", 6)], "doc_id long, text string, rule string, other int")
    got = {r.other: r for r in q.judge(docs, []).collect()}
    assert (got[5].n_words, got[5].n_dup_lines, got[5].n_repeat_words, got[5].base_failed) == (300_000, 99_999, 300_000, True)
    assert (got[6].n_words, got[6].base_failed, got[6].kept) == (0, True, False)
    assert q.judge(docs.limit(0), []).count() == 0


def test_held_out_documents_and_named_rules(spark):
    rows = labelled()
    known = {i for i, _, _ in rows if i % 7}
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, g) for i, _, g in rows if i in known] + [(None, 1), (3, None)], "doc_id long, quality int")
    rules = q.learned_rules(docs, lab)
    assert 1 <= len(rules) <= 4 and all(c.feature < len(q.FEATURES) for r in rules for c in r)
    got = {r.doc_id: r for r in q.judge(docs, rules).collect()}
    assert all(got[i].kept == bool(g) for i, _, g in rows if i not in known)
    assert {r.rule for r in got.values() if r.rule} == {q.named(r) for r in rules}
    assert q.learned_rules(docs, lab.where("quality = 1")) == [] and q.learned_rules(docs, lab.limit(0)) == []


def test_repeated_ids_are_judged_by_their_own_texts(spark):
    rows = labelled(400)
    lab = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, quality int")
    twice = spark.createDataFrame([(i, t) for i, t, _ in rows] * 2 + [(0, rows[3][1])], "doc_id long, text string")
    got = q.judge(twice, q.learned_rules(twice, lab)).where("doc_id = 0").select("kept").collect()
    assert sorted(r.kept for r in got) == [False, False, True]


def test_growing_stops_at_pure_rules_and_pruning_cuts_them():
    rng = np.random.default_rng(1)
    x = np.zeros((400, len(q.FEATURES)))
    x[:, 0], x[:, 2] = rng.random(400), rng.random(400)
    bad = (x[:, 0] > 0.5) & (x[:, 2] > 0.5)
    rule = q.grow(x, bad)
    assert q.covers(rule, x).tolist() == bad.tolist() and len(rule) == 2
    noise = (*rule, q.Condition(3, False, 0.0), q.Condition(0, False, 0.7))
    assert q.prune(noise, x, bad) == rule
    assert q.learn(x, np.zeros(400, bool), np.ones(400, bool)) == []
    coin = rng.random(400) < 0.5
    assert q.learn(x, coin, np.arange(400) % 3 > 0) == []


@pytest.mark.parametrize("low,high", [(0.1, 0.2), (0.0, 1e-9), (3.0, 3.5), (0.123456, 0.123457), (-1.0, 0.0)])
def test_thresholds_lie_between(low, high):
    assert low <= q.between(low, high) < high


def test_rules_run_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = q.judge(docs, [(q.Condition(0, True, 0.25), q.Condition(2, False, 0.5))])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "CASE WHEN" in plan and "Exchange" not in plan
    row = q.judge(docs.withColumn("text", F.repeat(F.lit("ab$ "), 60)), [(q.Condition(0, True, 0.25),)]).first()
    assert row.rule == "symbols_per_word > 0.25" and not row.kept
