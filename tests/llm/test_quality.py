import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import quality as q


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = ["the", "house", "river", "stands", "near", "old", "trees", "and", "people", "walk", "slowly", "home"]
    rows, labels = [], []
    for k in range(n):
        good = k % 5 != 0
        if good:
            t = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 60))).capitalize() + "."
        elif k % 2:
            t = "!! ".join(rng.choice(words).upper() for _ in range(30))
        else:
            t = " ".join([rng.choice(words)] * 40)
        rows.append((k, t))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, selected string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.drawn for r in q.resample(docs, lab, names=("w", "k", "drawn")).collect()}
    known = {i for i, _ in labels}
    right = [got[i] == (i % 5 != 0) for i, _ in rows if i not in known]
    assert np.mean(right) > 0.97


def test_weights_and_draw_equal_brute_force(spark):
    rows, labels = corpus(120)
    rows += [(500, None), (501, ""), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = q.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int"), k=50).toPandas()
    raw = np.zeros(q.BUCKETS)
    target = np.zeros(q.BUCKETS)
    fit = {i for i, (good, used) in q.labelled_sample(spark.createDataFrame(labels, "doc_id long, quality int"), 10**6, "doc_id", "quality").items() if good and used}
    for i, t in rows:
        b, _ = q.features((t or "").encode(), np.array([0, len((t or "").encode())]))
        np.add.at(raw, b, 1)
        if i in fit:
            np.add.at(target, b, 1)
    ratio = q.log_ratio(target, raw)
    for r in got.itertuples():
        b, _ = q.features((r.text or "").encode(), np.array([0, len((r.text or "").encode())]))
        assert np.isclose(r.log_weight, ratio[b].sum())
    least = sorted(got.draw_key, reverse=True)[49]
    assert (got.selected == (got.draw_key >= least)).all()


def test_kth_largest_narrows_down(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=3000) * 50) / 7
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    s = np.sort(v)[::-1]
    for k in (1, 17, 1500, 2999, 3000):
        want = float("-inf") if k >= 3000 else s[k - 1]
        assert q.kth_largest(df, "v", k, bins=8, few=40) == want
    assert q.kth_largest(df, "v", 0) == float("inf")


def test_whole_number_ids_of_any_type_and_long_texts(spark):
    rows, labels = corpus(60)
    rows[7] = (7, rows[7][1] * 20_000)  # more than a million characters
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    drawn = {}
    for kind in ("long", "int"):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("log_weight", F.lit("mine"))
        got = q.resample(docs, lab, k=10).collect()
        drawn[kind] = sorted(r.doc_id for r in got if r.selected)
        assert len(drawn[kind]) == 10 and all(isinstance(r.log_weight, float) for r in got)
    assert drawn["long"] == drawn["int"]


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.selected for r in q.resample(docs, none).collect())
    assert q.resample(docs.where("false"), none).count() == 0
