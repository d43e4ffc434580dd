from weftline.sources import normalize as n
from weftline.sources import readers as r
from weftline.sources import sinks

AT = "2026-09-11T08:00:00+08:00"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_college_courses(spark):
    raw = spark.createDataFrame(
        [("7", " 書法 ", "A社大", "1", "臺北市大安區路 12 號", "12", "3", "19:00:00", "21:00:00", "0", "09:30:00", "00:00:00", "1151", "", "2;99;4", "0000-00-00", None)],
        "course_id string, course_name string, school_name string, school_id string, address string, time_cat_id string, weekday string, time_begin string, time_end string, weekday_2 string, time_2_begin string, time_2_end string, quarter string, price string, course_tag_id_arr string, date_begin string, date_end string",
    )
    for c in ("time_info", "teach_status", "teacher_name", "credit", "course_url"):
        raw = raw.withColumn(c, n.F.lit(None).cast("string"))
    schools = spark.createDataFrame([("1", "臺北市")], "school_id string, region_name string")
    x = one(n.college_courses(raw, schools, AT))
    assert x.title == "書法" and x.location.city == "臺北市" and x.location.addressPrecision == "street"
    assert [(s.weekday, s.startTime, s.endTime) for s in x.schedule.slots] == [(3, "19:00", "21:00"), (7, "09:30", None)]
    assert x.term.year == 115 and x.term.season == "spring" and x.schedule.recurrence == "twice-weekly"
    assert x.price is None and x.isFree is None and x.schedule.startDate is None
    assert x.topicsRaw == ["公民素養", "環境永續"]


def test_seat_listing_full_overrides_status(spark):
    raw = spark.createDataFrame(
        [(5, "瑜珈", "s1", "全運", "106臺北市大安區1號", ["一", "x", "日"], "09:00:00", "10:00:00", "2026-09-01T00:00:00", "2026-10-30", 0, 0, 20, "2026-08-01T09:00:00", None, 1200.0, ["教室A"], [("2026-09-05", "颱風")])],
        "id long, title string, _siteId string, _siteTitle string, _siteAddress string, week array<string>, startTime string, endTime string, startDate string, endDate string, enrollmentStatus int, avaliableCount int, capacityMax int, regStartDate string, regEndDate string, price double, courtTitles array<string>, excludedDate array<struct<date:string,note:string>>",
    )
    for c in ("number", "_categoryName", "_siteHost"):
        raw = raw.withColumn(c, n.F.lit(None).cast("string"))
    x = one(n.seat_listing(raw, AT))
    assert (x.enrollment.status, x.enrollment.statusRaw, x.enrollment.available) == ("full", "已額滿", 0)
    assert [s.weekday for s in x.schedule.slots] == [1, 7] and x.term.raw == "11505"
    assert (x.location.city, x.location.district) == ("臺北市", "大安區")
    assert x.enrollment.opensAt == "2026-08-01T09:00:00+08:00" and x.schedule.timeInfoRaw == "停課：2026-09-05 颱風"


def test_training_status_and_prices(spark):
    raw = spark.createDataFrame(
        [("1", "課", "2026/9/1~2026/12/1", "2026/7/1~2026/8/1", "高雄市", "前鎮區", "凱旋四路105號", "政府負擔：10,000；學員負擔：2,500", "2", "^a ^ ^b", "單位")],
        "`課程編號` string, `課程名稱` string, `訓練期間` string, `報名期間` string, `訓練縣市` string, `訓練區域` string, `訓練地址` string, `經費` string, `數量` string, `訓練目標` string, `訓練單位名稱` string",
    )
    for c in ("分署", "單位名稱", "訓練時段", "訓練時數", "網址", "課程內容"):
        raw = raw.withColumn(c, n.F.lit(None).cast("string"))
    x = one(n.pre_job_training(raw, AT))
    assert x.schedule.startDate == "2026-09-01" and x.enrollment.status == "closed"
    assert x.location.address == "高雄市前鎮區凱旋四路105號" and x.price == 2500 and x.isFree is False
    assert x.term.year == 115 and x.description == "a\nb"


def test_portals_take_one_or_all_weekdays(spark):
    raw = spark.createDataFrame([("9", "書法", "社大", "星期五、星期二 (早上)", "招生中", 20, 25, "115", "115 年度 第2學期", "樂齡", "")], "courseId string, courseName string, school string, timeText string, statusText string, capacity int, enrolled int, _semester string, _semesterLabel string, tagText string, discountText string")
    a, b = one(n.taichung_portal(raw, AT)), one(n.hualien_portal(raw, AT))
    assert [s.weekday for s in a.schedule.slots] == [5] and [s.weekday for s in b.schedule.slots] == [5, 2]
    assert a.enrollment.status == "full" and a.enrollment.available == 0 and b.schedule.sessionsPerWeek == 2
    assert (a.term.year, a.term.season, a.topicsRaw) == (115, "autumn", ["樂齡"])


def test_venues_collapse(spark):
    raw = spark.createDataFrame(
        [(1, "館", "[206]台中市西區路1號", "66000", "游泳池", "24.1", "999"), (2, "館", "[206]台中市西區路1號", "66000", "籃球場", "24.2", "120.1"), (3, "NULL", "x", "1", "a", "", "")],
        "o int, `場館名稱` string, `地址` string, `縣市` string, `場館分類` string, `緯度` string, `經度` string",
    )
    for c in ("場館隸屬機關屬性", "行政區", "場館實際管理人電話", "場館官方網站"):
        raw = raw.withColumn(c, n.F.lit(None).cast("string"))
    x = one(n.sports_venues(raw, AT, "o"))
    assert x.city == "臺中市" and sorted(x.facilities) == x.facilities and len(x.facilities) == 2
    assert x.lat == 24.1 and x.lng is None


def test_inverted_dates_are_dropped(spark):
    raw = spark.createDataFrame([("http://x?id=9", "課", "園", "2026-01-01", "額滿為止")], "url string, NAduName string, AduName string, onAskStartDay string, onAskEnd string")
    x = one(n.nature_courses(raw, AT))
    assert x.enrollment.closesRuleRaw == "額滿為止" and x._sourceRecordId == "9" and x.enrollment.status == "unknown"
    df = n.shaped(spark.range(1), n.COURSE, {"schedule.startDate": n.F.lit("2026-05-01"), "schedule.endDate": n.F.lit("2026-04-01")})
    assert one(n.drop_inverted(df)).schedule.endDate is None


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,note\r\n\"a \"\"q\"\"\",\"x\ny\"\r\n,\r\nb,\r\n".encode())
    rows = r.csv_any_encoding(spark, str(tmp_path / "a.csv")).collect()
    assert [(x.name, x.note) for x in rows] == [('a "q"', "x\ny"), ("b", "")]
    (tmp_path / "b.csv").write_bytes("name\n臺北\n".encode("big5"))
    assert r.csv_any_encoding(spark, str(tmp_path / "b.csv")).first().name == "臺北"
    (tmp_path / "c.json").write_text('[{"a": 1, "b": "x"}, {"a": 2}]')
    assert r.json_array(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "f.xml").write_text("<rss><item><title>A</title><d><![CDATA[ x ]]></d></item><item><title>B</title></item></rss>")
    items = [x["item"] for x in r.rss_items(spark, str(tmp_path / "f.xml")).collect()]
    assert {"title": "A", "d": "x"} in items and {"title": "B"} in items


def test_markup_tables(spark):
    html = "<table><tr><th>一</th><th>二</th></tr><tr><td>x</td><td>y</td></tr></table>"
    df = spark.createDataFrame([(1, html)], "k int, t string")
    cells = r.grid(df, ["k"], "t").collect()
    assert [(c.heading, c.cell) for c in cells] == [("一", "x"), ("二", "y")]
    doc = spark.createDataFrame([(1, "<h>週一</h><a>1</a><a>2</a><h>週二</h><a>3</a>")], "k int, t string")
    got = r.carried_headers(doc, ["k"], "t", "<h>(.*?)</h>", "<a>.*?</a>").orderBy("pos").collect()
    assert [(g.header, g.item) for g in got] == [("週一", "<a>1</a>"), ("週一", "<a>2</a>"), ("週二", "<a>3</a>")]
    assert spark.range(1).select(r.labelled(n.F.lit("地點： A館\n時間：x"), "地點")).first()[0] == "A館"


def test_sinks(spark, tmp_path):
    urls = spark.createDataFrame([(f"https://a/{k}&", f"2026-01-{k:02d}") for k in range(1, 8)], "loc string, lastmod string")
    entries, index = sinks.sitemap(urls, 3)
    assert sorted((x.file, x.n) for x in index.collect()) == [(1, 3), (2, 3), (3, 1)]
    assert "&amp;" in entries.first().value
    sinks.write_sitemap(entries, str(tmp_path / "s"))
    sinks.write_ndjson(urls, str(tmp_path / "n"), "loc", 2)
    assert spark.read.json(str(tmp_path / "n")).count() == 7
    row = sinks.positional(spark.createDataFrame([("a", None, 3)], "x string, y string, z int"), ["x", "y", "z"]).first().value
    assert row == '["a",null,3]'
    doc = spark.range(1).select(sinks.json_ld("Course", {"name": n.F.lit("x"), "note": n.F.lit("")})).first()[0]
    assert '"name":"x"' in doc and "note" not in doc
