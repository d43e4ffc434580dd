from pyspark.sql import functions as F

from weftline.streaming import live

KIND = "id long, payload string, content_hash string, first_observed string, last_verified string, last_changed string, disappeared string"


def run(query):
    q = query.start()
    q.processAllAvailable()
    q.stop()


def test_merge_by_micro_batch(spark, tmp_path):
    load, save = live.versions(spark, str(tmp_path / "v"), KIND)
    src = str(tmp_path / "in")
    for k, rows in enumerate(([(1, "a", "h1"), (2, "b", "h2")], [(2, "b", "h9"), (3, "c", "h3")])):
        spark.createDataFrame(rows, "id long, payload string, content_hash string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long, payload string, content_hash string").parquet(src)
        run(live.merge_stream(stream, load, save, lambda batch, n: F.lit(f"2026-01-0{n + 1}")).option("checkpointLocation", str(tmp_path / "cp")))
    load, save = live.versions(spark, str(tmp_path / "v"), KIND)  # as after a restart
    assert {r.id for r in load(1).collect()} == {1, 2} and load(0).count() == 0
    got = {r.id: r for r in load().collect()}
    assert set(got) == {1, 2, 3} and got[1].disappeared == "2026-01-02" and got[3].first_observed == "2026-01-02" and got[2].content_hash == "h9"


def test_windowed_counts_and_schedules(spark, tmp_path):
    spark.createDataFrame([("2026-01-01 10:00:00", "a"), ("2026-01-01 11:00:00", "a"), ("2026-01-05 00:00:00", "b")], "at string, k string").select(F.to_timestamp("at").alias("at"), "k").coalesce(1).write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("at timestamp, k string").parquet(str(tmp_path / "e"))
    run(live.windowed_counts(events, "at", ["k"]).writeStream.outputMode("complete").format("memory").queryName("counts"))
    assert {(r.k, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}
    runs = [("s", 1, "h", False), ("s", 2, "h", False), ("s", 3, None, True)]
    spark.createDataFrame(runs, "source string, at_ms long, new_hash string, failed boolean").coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema("source string, at_ms long, new_hash string, failed boolean").parquet(str(tmp_path / "r"))
    run(live.schedule_stream(stream).writeStream.outputMode("update").format("memory").queryName("plan"))
    r = spark.table("plan").first()
    assert (r.interval_ms, r.unchanged, r.failures, r.next_due_ms) == (64_800_000, 1, 1, 64_800_003)
