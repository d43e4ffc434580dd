import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import pages as P


def test_topics_keep_order_and_refuse_unknown_ones(spark):
    known = spark.createDataFrame([("語言", 1), ("運動", 2), ("藝術", 3)], "name string, k int")
    df = spark.createDataFrame([("運動", True, "title"), ("運動", False, "source"), ("語言", True, "source"), (None, True, "x"), ("", True, "x")], "cat string, o boolean, f string")
    got = [tuple(r) for r in P.topics(df, "cat", known, "name", "k", F.col("o"), F.col("f") == "title").orderBy("ord").collect()]
    assert got == [("語言", 1, 1, 1, 0), ("運動", 2, 2, 1, 1)]
    with pytest.raises(ValueError):
        P.topics(df.unionByName(spark.createDataFrame([("雜項", True, "x")], df.schema)), "cat", known, "name", "k", F.col("o"), F.col("o"))


def test_college_hubs(spark):
    rows = [("臺北市北投區社大", None)] * 1 + [("北投社區大學", "臺北市")] * 3 + [("台北市北投社區大學", "臺北市")] * 2 + [("花蓮社大", "花蓮縣"), ("花蓮縣社區大學", None)] + [("海線社區大學", "雲林縣"), ("臺中市海線社大", None)] + [("北投社大", None), ("無處社大", None)]
    df = spark.createDataFrame([(*r, k % 2 == 0) for k, r in enumerate(rows)], "p string, city string, o boolean")
    got = {(r.name, r.city): r.n for r in P.college_hubs(df, "p", "city", F.lit(True), F.col("o")).collect()}
    assert got[("北投社區大學", "臺北市")] == 6 and got[("花蓮縣社區大學", "花蓮縣")] == 2
    assert got[("雲林縣海線社區大學", "雲林縣")] == 1 and got[("臺中市海線社區大學", "臺中市")] == 1
    assert len(got) == 5


def test_crumbs(spark):
    got = spark.range(1).select(P.crumbs("cities", (F.lit("臺北市"), F.lit("/city/x.html")), (F.lit("課"), F.lit("/self"))).alias("a"), P.crumbs(None, (F.lit(None).cast("string"), F.lit("/y")), (F.lit("課"), None)).alias("b")).first()
    assert [tuple(x) for x in got.a] == [("首頁", "/"), ("縣市", "/cities.html"), ("臺北市", "/city/x.html"), ("課", None)] and [tuple(x) for x in got.b] == [("首頁", "/"), ("課", None)]


def test_sitemap_problems(spark):
    pages = spark.createDataFrame([("a.html", True), ("city/臺北.html", True), ("old.html", False), ("new.html", True)], "path string, indexed boolean")
    site = "https://x.tw"
    rows = [
        (1, f"{site}/a.html", "2026-01-01", "daily", "0.5"),
        (1, f"{site}/city/%E8%87%BA%E5%8C%97.html", None, None, None),
        (1, f"{site}/city/臺北.html", None, None, None),
        (1, f"{site}/old.html", "2026-1-1", "often", "2"),
        (2, f"{site}/gone.html", None, None, "x"),
        (2, f"{site}/gone.html", None, None, None),
        (2, "https://y.tw/a.html", None, None, None),
        (2, None, None, None, None),
    ]
    e = spark.createDataFrame(rows, "file int, loc string, lastmod string, changefreq string, priority string")
    got = {(r.loc and r.loc.removeprefix(site), r.problem) for r in P.sitemap_problems(e, pages, site, 4).collect()}
    assert got == {
        ("/city/臺北.html", "wrong encoding"), ("/old.html", "not to be indexed"), ("/old.html", "date"), ("/old.html", "frequency"), ("/old.html", "priority"), ("/gone.html", "no such page"), ("/gone.html", "repeated"), ("/gone.html", "priority"), ("https://y.tw/a.html", "not of this site"), (None, "no address"), ("new.html", "page not listed"),
    }
    assert ("1", "file too long") in {(r.loc, r.problem) for r in P.sitemap_problems(e, pages, site, 3).collect()}


def test_document_problems(spark):
    good = {"provider": {"name": "a"}, "offers": {"price": 5, "priceCurrency": "TWD", "availability": "https://schema.org/InStock"}, "hasCourseInstance": {"courseSchedule": {"byDay": ["https://schema.org/Monday"], "startDate": "2026-01-01", "repeatFrequency": "P1W"}, "location": {"geo": {"latitude": 25.0, "longitude": 121.0}}}}
    bad = {"description": "x" * 301, "offers": {"price": "free", "availability": "maybe"}, "hasCourseInstance": {"courseSchedule": {"byDay": ["Monday"], "startDate": "soon", "repeatFrequency": "weekly"}, "location": {"geo": {"latitude": 5.0, "longitude": 121.0}}}}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, json.dumps({"provider": {}})), (4, None)], "id long, j string")
    got = {}
    for r in P.course_ld_problems(df, "id", "j").collect():
        got.setdefault(r.id, set()).add(r.problem)
    assert got.get(1) is None and got[2] == {"long description", "no provider", "availability", "price is no number", "price without currency", "day", "start date", "frequency", "coordinates"} and got[3] == {"provider without a name"}
    typed = [{"offers": {"price": "100", "priceCurrency": "TWD"}}, {"hasCourseInstance": {"offers": {"availability": "maybe"}}}, {"offers": {"price": True, "priceCurrency": "TWD"}}, {"offers": {"price": 1.5e3, "priceCurrency": "TWD"}}]
    df = spark.createDataFrame([(k, json.dumps({"provider": {"name": "a"}} | x)) for k, x in enumerate(typed)], "id long, j string")
    assert {(r.id, r.problem) for r in P.course_ld_problems(df, "id", "j").collect()} == {(0, "price is no number"), (1, "availability"), (2, "price is no number")}
    trail = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", None), ("d", 1), ("d", 1)], "l string, position int")
    assert {r.l for r in P.crumb_ld_problems(trail, "l").collect()} == {"b", "c", "d"}
    items = spark.createDataFrame([("a", 1, "u"), ("a", 2, "v"), ("a", 3, "w"), ("b", 1, "u"), ("b", 3, "u"), ("c", 1, None), ("c", 2, "u"), ("c", 3, "v")], "l string, position int, url string")
    assert {(r.l, r.problem) for r in P.list_ld_problems(items, "l").collect()} == {("b", "too short"), ("b", "positions"), ("b", "repeated address"), ("c", "no address")}


def test_main_venues(spark):
    rows = [("A", 1, True)] * 3 + [("A", 2, True)] * 1 + [("B", 1, True)] * 1 + [("B", 3, False)] * 2 + [("C", 4, False)] * 2 + [(None, 4, True)] * 2 + [("D", 5, True), ("D", 6, True), ("E", None, True)]
    df = spark.createDataFrame(rows, "c string, v int, now boolean")
    every = df.select(F.col("v").alias("venue"))
    got = {(r.college, r.venue, r.n, r.share) for r in P.main_venues(df, "c", "v", F.col("now"), every).collect()}
    assert got == {("A", 1, 3, 0.75), ("D", 5, 1, 1.0)}  # C has half of its venue, B's current one belongs to A
    assert P.main_venues(df, "c", "v", F.col("now"), every.where("venue > 1")).where("college = 'A'").count() == 0
