import corpus_pipeline as cp
from weftline.llm.jaccard_join import jaccard_components
from weftline.llm.scratch import cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_removed string"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    from tests.llm.test_quality import corpus

    rows, labels = corpus(300)
    rows = [(i, t + f"\nline number {i} of its own with words {i * 7}") for i, t in rows]
    base = " ".join(f"u{k}" for k in range(80))
    near = [(900, base + " tail one"), (901, base + " tail two"), (902, None), (903, "")]
    data = [(i, t, "en", f"src{i % 5}", len(t or ""), "mine") for i, t in rows + near]
    spark.createDataFrame(data, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        columns = docs.columns
        docs = cut(stage(spark, docs, str(tmp_path)), name)
        after = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and after <= before
        assert {r.n_removed for r in docs.collect()} == {"mine"}
        if name == "quality":
            assert len([i for i in before - after if i % 5 and i < 900]) < 5
            assert len([i for i in after if i % 5 == 0 and i < 300]) < 5
        if name == "near_duplicates":
            left = jaccard_components(docs, n=5, percent=80).collect()
            assert all(r.doc_id == r.component_id for r in left)
    packed = cp.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == after


def test_rows_with_one_id_are_judged_by_their_texts(spark):
    base = " ".join(f"u{k}" for k in range(60))
    rows = [(1, base), (2, base + " more"), (2, "another text of its own that nobody else has"), (3, None), (3, None), (None, base), (5, "x " * 300_000)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "mine") for i, t in rows], DOCS)
    got = sorted((r.doc_id or -1, len(r.text or "")) for r in cp.near_duplicates(spark, df, "").collect())
    assert got == sorted([(1, len(base)), (2, len(rows[2][1])), (3, 0), (-1, len(base)), (5, 600_000)])


def test_mixing_keeps_its_budget_whatever_the_ids(spark):
    for ids in ([None] * 40, [7] * 40, list(range(40))):
        rows = [(i, f"w{k} three words", "en", "web1", 1, "mine") for k, i in enumerate(ids)]
        kept = cp.mix(spark, spark.createDataFrame(rows, DOCS), "").count()
        assert kept == 36
    same = spark.createDataFrame([(None, "three equal words", "en", "web1", 1, "mine")] * 40, DOCS)
    assert cp.mix(spark, same, "").count() in (0, 40)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
