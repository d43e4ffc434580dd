"""Sinks read back: raw records, upload files, tables laid out by columns; pages up to a cutoff."""

import glob

from pyspark.sql import functions as F

from weftline.sources import readers, sinks


def test_raw_records_and_upload_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "b,x"), (1, "甲"), (3, None)], "id long, v string")
    sinks.write_raw(df, str(tmp_path / "raw"))
    assert sorted((r.id, r.v) for r in spark.read.json(str(tmp_path / "raw")).collect()) == [(1, "甲"), (2, "b,x"), (3, None)]
    sinks.upload_batches(df, [F.col("id")], 2, str(tmp_path / "up"))
    files = {}
    for path in glob.glob(str(tmp_path / "up" / "batch=*" / "part-*.csv")):
        with open(path, "rb") as f:
            files.setdefault(path.split("batch=")[1].split("/")[0], []).append(f.read().decode("utf-8"))
    assert sorted(files) == ["1", "2"] and all(len(v) == 1 for v in files.values())
    assert files["1"][0].split("\r\n")[:3] == ["﻿id,v", "1,甲", '2,"b,x"'] and files["2"][0].startswith("﻿id,v\r\n3,")


def test_pages_up_to_a_cutoff(spark):
    df = spark.createDataFrame([(1, "2026-05-03"), (1, "2026-05-02"), (2, "2026-05-01"), (2, "2026-04-30"), (3, "2026-04-01")], "page int, day string")
    assert {r.page for r in readers.rows_until(df, "page", "day", "2026-05-01").collect()} == {1, 2}
    assert readers.rows_until(df, "page", "day", "2020-01-01").count() == 5
