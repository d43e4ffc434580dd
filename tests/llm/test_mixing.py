import duckdb
import pandas as pd

from weftline.llm import mixing as m


def leaves(spark, rows):
    return spark.createDataFrame(rows, "domain string, lang string, source string, supply long, weight long")


def test_shortage_goes_to_siblings_before_ancestors(spark):
    from pyspark.sql import functions as F

    rows = [("a", "en", "s1", 10, 1), ("a", "en", "s2", 1000, 1), ("a", "de", "s3", 1000, 2), ("b", "en", "s4", 1000, 4)]
    got = {r.source: r.budget for r in m.leaf_budgets(leaves(spark, rows), m.LEVELS, F.lit(800).cast("long"), 1).collect()}
    # each domain has weight 4: 400 each; a: 200 to en and to de; en: s1 gives 10, its sibling takes the rest
    assert got == {"s1": 10, "s2": 190, "s3": 200, "s4": 400}
    rows[1] = ("a", "en", "s2", 50, 1)  # all of en is short: de takes it, not the other domain
    got = {r.source: r.budget for r in m.leaf_budgets(leaves(spark, rows), m.LEVELS, F.lit(800).cast("long"), 1).collect()}
    assert got == {"s1": 10, "s2": 50, "s3": 340, "s4": 400}


def test_query_equals_its_sql_with_hot_leaf_and_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "SLICE", 16)
    rows = [(k, "w " * (k * 13 % 40), ["en", "de", None][k % 3], f"src{k % 7 if k % 2 else 0}") for k in range(400)] + [(900, None, "en", None), (901, "", "fr", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = m.op8_source_mixing(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(m.ORACLE).df()
    key = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(pd.notna(d[sorted(d.columns)]), None).values.tolist()))
    assert key(got) == key(want)
    total = sum(len((r[1] or "").split()) for r in rows)
    assert 0.4 * total < got.n_tokens.sum() <= total / 2


def test_epochs_repeat_whole_leaves(spark):
    df = spark.createDataFrame([(1, "a", "x", "s", 10), (2, "a", "x", "s", 10), (3, "b", "y", "t", 1000)], "doc_id long, domain string, lang string, source string, n_tokens long")
    got = m.mix_sources(df, fraction=(1, 1), power=0.0, max_epochs=3).toPandas()
    assert (got[got.source == "s"].groupby("doc_id").epoch.nunique() == 3).all()
    assert len(got[got.source == "t"]) == 0 or got[got.source == "t"].n_tokens.sum() <= 1000


def test_target_weights_are_met_where_supply_allows(spark):
    rows = [(k, d, "x", s, 10) for k, (d, s) in enumerate([("web", "a")] * 900 + [("books", "b")] * 600 + [("forums", "c")] * 30 + [("other", "d")] * 600)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    got = m.mix_sources(df, max_epochs=1, targets={"domain": {"web": 500, "books": 200, "forums": 200}}).groupBy("domain").agg({"n_tokens": "sum"}).collect()
    # 10,650 tokens; forums can give 300 of 2,130, and what it lacks goes to the others by 5 : 2 : 1
    assert {r[0]: r[1] for r in got} == {"web": 6460, "books": 2580, "forums": 300, "other": 1290}


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a", "x", "s", 10, "c", 7)] * 3 + [(2, "a", "x", "s", 5, "c", 7)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long, __id string, __t int")
    got = m.mix_sources(df, fraction=(1, 1), max_epochs=1)
    assert got.columns == ["domain", "lang", "source", "doc_id", "n_tokens", "epoch"] and sorted(r.doc_id for r in got.collect()) == [1, 1, 1, 2]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, domain string, lang string, source string, n_tokens long")
    assert m.mix_sources(df).count() == 0


def test_rows_of_one_id_are_counted_before_they_are_ordered(spark, monkeypatch):
    monkeypatch.setattr(m, "SLICE", 8)
    rows = [(None, "a", "x", "s", t) for t in [3] * 40 + [2] * 25 + [0] * 9] + [(5, "a", "x", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    mixed = m.mix_sources(df, fraction=(1, 2), max_epochs=1)
    got = mixed.toPandas()
    total = 40 * 3 + 25 * 2 + 4
    assert total // 2 - 4 < got.n_tokens.sum() <= total // 2
    assert (got.n_tokens == 0).sum() in (0, 9)
    assert all(n <= {3: 40, 2: 25, 0: 9, 4: 1}[t] for t, n in got.n_tokens.value_counts().items())
