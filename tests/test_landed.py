"""Landed files through the data source: formats, pruning, and on to the mappings."""

import json

import pytest

from weftline.sources import landed as L

AT = "2026-09-13T08:00:00+08:00"


def land(root, source, day, name, data):
    folder = root / source / day
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def test_formats_and_columns(spark, tmp_path):
    land(tmp_path, "s", "2026-01-01", "a.json", "﻿" + json.dumps([{"x": 1, "n": "7", "list": [{"p": "q", "z": 2}]}, {"x": None, "n": "no", "list": "no"}, "no record"]))
    land(tmp_path, "s", "2026-01-02", "b.ndjson", '{"x":"é"}\n\n{"y":2}\n')
    land(tmp_path, "s", "2026-01-03", "c.csv", '"x",n\r\n"臺\n灣",3\r\n,\r\n'.encode("cp950"))
    land(tmp_path, "s", "2026-01-03", "d.xml", "<rss><item><x><![CDATA[ t ]]></x></item></rss>")
    land(tmp_path, "s", "2026-01-03", "_skipped.json", "[]")
    land(tmp_path, "s", "2026-01-04", "e.json", "")
    kind = spark.createDataFrame([], "x string, n int, list array<struct<p:string>>, _file string, _landed string").schema
    got = sorted((r._file, r._landed, r.x or "", r.n or 0, len(r.list or [])) for r in L.landed(spark, f"file://{tmp_path}", "s", kind).collect())
    assert got == [("a.json", "2026-01-01", "", 0, 0), ("a.json", "2026-01-01", "1", 7, 1), ("b.ndjson", "2026-01-02", "", 0, 0), ("b.ndjson", "2026-01-02", "é", 0, 0), ("c.csv", "2026-01-03", "臺\n灣", 3, 0), ("d.xml", "2026-01-03", "t", 0, 0)]
    assert L.landed(spark, f"file://{tmp_path}", "nothing", kind).count() == 0


def test_days_and_names_leave_out_files(spark, tmp_path):
    land(tmp_path, "s", "2026-01-01", "bad.json", "this is no JSON")
    for day in ("2026-01-02", "2026-01-03"):
        land(tmp_path, "s", day, "a.ndjson", '{"x":"1"}\n{"x":"2"}\n')
    kind = spark.createDataFrame([], "x string, _file string, _landed string").schema
    df = L.landed(spark, f"file://{tmp_path}", "s", kind, since="2026-01-02")
    assert df.where("x = '1'").count() == 2 and df.count() == 4 and df.rdd.getNumPartitions() == 2
    assert L.landed(spark, f"file://{tmp_path}", "s", kind, until="2026-01-02", file="a.ndjson").count() == 2
    with pytest.raises(Exception, match="JSON|Expecting"):
        L.landed(spark, f"file://{tmp_path}", "s", kind).collect()


def test_a_schema_is_what_the_mapping_reads(spark, tmp_path):
    schema = L.raw_schema(spark, "taichung-cc")
    assert {"courseId", "timeText", "_file"} <= set(schema.names) and schema["capacity"].dataType.simpleString() == "int"
    assert "school_id" in L.raw_schema(spark, "moe-cc-courses").names
    land(tmp_path, "taichung-cc", "2026-09-12", "old.json", json.dumps([{"courseId": "0", "courseName": "舊"}]))
    land(tmp_path, "taichung-cc", "2026-09-13", "a.json", json.dumps([{"courseId": 5, "courseName": "書法", "_semester": "114-1", "timeText": "星期三 晚上", "capacity": 20, "enrolled": 20, "statusText": "招生中", "extra": 1}]))
    got = L.observed(spark, f"file://{tmp_path}", "taichung-cc", AT, since="2026-09-13").collect()
    assert [(r._sourceRecordId, r.title, r.enrollment.status, r.schedule.slots[0].weekday) for r in got] == [("114-1:5", "書法", "full", 3)]


def test_files_are_read_piece_by_piece(tmp_path):
    import io

    class Counted(io.BytesIO):
        most = 0

        def read(self, n=-1):
            got = super().read(n)
            self.most = max(self.most, len(got))
            return got

        read1 = read

    rows = [{"x": k, "s": "臺" * (k % 50), "n": {"y": [k, None, "]}"]}} for k in range(20_000)]
    lines = [json.dumps(r, ensure_ascii=False) for r in rows]
    made = {"a.json": json.dumps(rows), "b.json": "\n".join(lines) + "\n", "c.json": " [" + ",\n ".join(lines) + "]\n", "d.ndjson": "\r\n".join(lines), "e.json": "[]", "f.json": " \n", "g.json": '{"x": 1}'}
    for name, text in made.items():
        f = Counted(("\ufeff" + text).encode())
        assert L.encoding_of(f, "cp950") == "utf-8-sig"
        f.seek(0)
        assert list(L.records(f, name, "utf-8-sig")) == ([] if name in ("e.json", "f.json") else [{"x": 1}] if name == "g.json" else rows), name
        assert f.most <= 4 * L.CHUNK
    items = "<rss>" + "".join(f"<item id='{k}'><t>{'x' * (k % 900)}{k}</t></item>\n" for k in range(2000)) + "</rss>"
    assert [r["t"].lstrip("x") for r in L.records(io.BytesIO(items.encode()), "a.rss", "utf-8-sig")] == [str(k) for k in range(2000)]
    assert L.encoding_of(io.BytesIO("臺灣".encode("cp950")), "cp950") == "cp950" and L.encoding_of(io.BytesIO("臺".encode()[:2]), "cp950") == "cp950"
    for bad in ("this is no JSON", '[{"x": 1}', '[{"x": 1} {"x": 2}]', '{"x": 1} {"x": 2}', '[{"x": 1},]', "[1] 2"):
        with pytest.raises(json.JSONDecodeError):
            list(L.records(io.BytesIO(bad.encode()), "a.json", "utf-8-sig"))
