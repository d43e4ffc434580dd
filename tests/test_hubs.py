"""Hand-written cases of hubs, shown names and geocoding preparation."""

from pyspark.sql import functions as F

from weftline.functions import display as V
from weftline.operators import geocode as G
from weftline.operators import hubs as H

L = F.lit


def nothing():
    return L(None).cast("string")


def val(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_membership(spark):
    got = val(
        spark,
        H.is_senior(L("senior-center"), nothing(), nothing()), H.is_senior(L("vocational"), L("銀髮照護"), nothing()), H.is_senior(L("vocational"), L("中高齡烘焙"), nothing()), H.is_senior(L("community-college"), L("長青歌唱"), nothing()), H.is_senior(L("other"), L("歌唱"), L("樂齡族")), H.is_senior(nothing(), nothing(), nothing()),
        H.program_of(L("vocational"), L("產業人才投資方案"), F.array(L("x"))), H.program_of(L("vocational"), nothing(), F.array(L("mol-6060"))), H.program_of(L("other"), nothing(), F.array(L("mol-6060"))), H.program_of(nothing(), L("失業者職前訓練"), F.array(L("x"))),
        H.is_cert(L("丙級烘焙"), nothing()), H.is_cert(L("烘焙"), L("結訓後輔導同學報考乙級")), H.is_cert(L("烘焙"), L("取得。證照")), H.is_cert(nothing(), nothing()), H.is_kids(L("6 ~ 9 歲游泳")), H.is_kids(L("游泳")),
        H.venue_of(L("sports-center"), L("大里中心"), L("大里中心 A1")), H.venue_of(L("library"), L("總館"), L("B1")), H.in_page_types(L("/course/x.html"), ["course"]), H.in_page_types(L("city/course.html"), ["course"]),
    )
    assert got == (True, False, True, True, True, False, ["產投"], ["職前訓練"], [], ["職前訓練"], True, True, False, False, True, False, "大里中心", "B1", True, False)


def test_names(spark):
    two = F.array(F.struct(L("甲社大").alias("name"), L(3).alias("n")), F.struct(L("乙社大").alias("name"), L(2).alias("n")))
    three = F.array_append(two, F.struct(L("丙").alias("name"), L(1).alias("n")))
    got = val(
        spark,
        V.short_city(L("臺北市")), V.short_city(L("新竹縣")), V.short_city(nothing()), V.short_district(L("東區")), V.short_district(L("大安區")), V.short_center(L("臺北市內湖國民運動中心")), V.mentions_city(L("台北市社大"), L("臺北市")), V.mentions_city(L("x"), nothing()),
        V.course_title(L("瑜珈"), L("松山社大"), L("臺北市"), L("2026-09-01"), L("週六 19:00"), L(False)), V.course_title(L("瑜珈"), nothing(), L("臺北市"), nothing(), L("週六"), L(True)), V.course_title(L("瑜珈"), L("新竹市社大"), L("新竹縣"), L("2026-01-05"), nothing(), L(True)),
        V.venue_heading(L("中正路12號"), nothing(), two, L(5)), V.venue_heading(L("中正路12號"), nothing(), three, L(9)), V.venue_heading(L("某某館"), nothing(), two, L(5)), V.venue_heading(L("中正路12號"), L("松山館"), two, L(5)), V.venue_heading(L("東山里3鄰5號"), nothing(), F.slice(two, 1, 0), L(1)),
        V.semester_rank(L("115年第二學期")), V.semester_rank(L("115-1秋季")), V.semester_rank(L("暑期")), V.latest(F.array(L(""), nothing(), L("2026-01-01"))), V.latest(F.array(nothing())),
    )
    assert got[:8] == ("台北", "新竹縣", "", "東區", "大安", "內湖運動中心", True, False)
    assert got[8:11] == ("瑜珈｜松山社大（台北） 2026 秋季", "瑜珈｜臺北市 週六", "瑜珈｜新竹市社大 2026 冬季")
    assert got[11:16] == ("中正路12號（甲社大上課地點）", "中正路12號（甲社大、乙社大等 3 個單位的上課地點）", "某某館", "松山館（中正路12號）", "東山里3鄰5號")
    assert [tuple(x) for x in got[16:19]] == [(115, 2.0), (115, 2.0), (0, 1.5)] and got[19:] == ("2026-01-01", None)


def test_clean_addresses(spark):
    cases = {
        ("公民教室:承德路四段190號2樓", "臺北市"): "臺北市承德路4段190號",
        ("後甲國中(台南市東區林森路二段260號", None): "臺南市東區林森路2段260號",
        ("臺北市信義區110臺北市信義區松仁路158巷1號", None): "臺北市信義區松仁路158巷1號",
        ("臺北市大安區吉利分館--臺北市北投區立農街1段366號", None): "臺北市北投區立農街1段366號",
        ("臺北市北投區北投國中教學點-北投區溫泉里溫泉路62號", None): "臺北市北投區溫泉里溫泉路62號",
        ("臺北市北投區校本部北投區中山路5之12號", None): "臺北市北投區中山路5之12號",
        ("臺北市中山區北市中山區吉林路110號", None): "臺北市中山區吉林路110號",
        ("雲林縣西螺鎮中市路31號", None): "雲林縣西螺鎮中市路31號",
        ("臺南市官田區官田工業區工業路40號", None): "臺南市官田區工業路40號",
        ("臺中市西屯區工業區一路100號", None): "臺中市西屯區工業區一路100號",
        ("臺南市麻豆區總爺104號", None): "臺南市麻豆區總爺104號",
        ("[40341]台中市五權路２－３號", None): "臺中市五權路2之3號",
        ("教室3號", "臺北市"): None,
        ("中山路一號", None): None,
        ("鹿港鎮公所", "彰化縣"): None,
        ("", "臺北市"): None,
        (None, None): None,
    }
    rows = spark.createDataFrame([(k, c, v) for (k, c), v in cases.items()], "raw string, county string, want string")
    got = rows.select("raw", "want", G.clean_address(F.col("raw"), F.col("county")).alias("got")).collect()
    assert [(r.raw, r.got) for r in got] == [(r.raw, r.want) for r in got]


def test_places(spark):
    got = val(spark, G.place_candidates(L("校本部（河濱國小)")), G.place_candidates(L("東勢區-東勢區東勢高工教室")), G.place_candidates(nothing()), G.school_keys(L("臺北市立 文澳國民小學")), G.school_keys(nothing()))
    assert got == (["河濱國小"], ["東勢區", "東勢區東勢高工", "東勢高工"], [], ["文澳國民小學", "文澳國小"], [])
    rows = spark.createDataFrame([(1, ["無此處", "河濱國民小學"]), (2, ["中山國小"]), (3, ["中山國小", "文澳國小"])], "id long, names array<string>")
    index = spark.createDataFrame([("河濱國小", "a1"), ("中山國小", "a2"), ("中山國小", "a3"), ("文澳國小", "a4")], "place string, address string")
    assert {r.id: r.address for r in G.unique_place(rows, "id", "names", index).collect()} == {1: "a1", 3: "a4"}


def test_answers_of_a_geocoder(spark):
    keys = spark.createDataFrame([("1", "臺北市甲路1號", "k1"), ("1", "臺北市甲路1號", "k2"), ("2", "臺北市乙路2號", "k3"), ("3", "澎湖縣丙", "k4")], "id string, address string, key string")
    answers = spark.createDataFrame([("1", None, "臺北市甲路1號", 121.5, 25.0), (None, "臺北市乙路2號", "臺北市乙路2號", 1.0, 2.0), ("3", "", "臺東縣丙", 121.1, 22.7), ("9", None, None, 121.0, 24.0)], "id string, address string, matched string, x double, y double")
    good, bad = G.accepted(answers, keys)
    assert sorted((r.key, r.lat, r.lng) for r in good.collect()) == [("k1", 25.0, 121.5), ("k2", 25.0, 121.5)]
    assert sorted((r.sent or "", r.why) for r in bad.collect()) == [("", "unknown address"), ("澎湖縣丙", "another county"), ("臺北市乙路2號", "out of range")]


def test_examples_and_kinds(spark):
    df = spark.createDataFrame([(1, 3, True, False, "a"), (2, 2, True, True, None), (3, 1, True, True, "a"), (4, 5, False, False, None), (5, 2, True, False, "a")], "id long, s int, d boolean, f boolean, kind string")
    got = [(r.example, r.id) for r in H.digest_examples(df, "id", "s", F.col("d"), F.col("f"), 2).collect()]
    assert got == [("sources", 1), ("sources", 2), ("almost full", 2), ("almost full", 3)]
    assert {r.kind: r.n for r in H.by_kind(df, "kind").collect()} == {"a": 3, "other": 2}
