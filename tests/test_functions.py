from pyspark.sql import functions as F

from weftline.functions import dates as D
from weftline.functions import display as S
from weftline.functions import geo as G
from weftline.functions import numerals as N
from weftline.functions import text as X
from weftline.operators import rules as R


def val(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


L = F.lit


def test_text(spark):
    got = val(
        spark,
        X.to_half(L("ＡＢ１！")),
        X.trim_all(L("　 x 　")),
        X.replace_first(L("a1b1"), "1", "-"),
        X.norm_school(L("台北市文山社區大學")),
        X.norm_title(L("【新】瑜珈（第3期）★ A-1")),
        X.strip_promo_prefix(L("【新】[熱] 書法")),
        X.strip_promo_prefix(L("【新】【書法】")),
        X.truncate(L("abcdef"), 4),
        X.encode_uri_component(L("a b~*(é)")),
        X.html_text(L("<p>a&amp;lt;</p><script>x</script> b&nbsp;c")),
        X.decode_entities(L("&#20013;&eacute;")),
        X.normalize_name(L("é-Ａ 中")),
        X.paragraphs(L(" a ^^ b ")),
        X.title_key(L("書法 第3期!")),
        X.fmt_duration(L(5_400_000)),
        X.clip(L("中文字"), 2),
    )
    assert got == ("AB1!", "x", "a-b1", "文山", "瑜珈A1", "書法", "【書法】", "abc…", "a%20b~*(%C3%A9)", "a&lt; b c", "中é", "éA中", "a\nb", "書法", "1.5h", "中文")


def test_numerals(spark):
    words = {"十": 10, "二十三": 23, "一百零五": 105, "九百九十九": 999, "三": 3, "兩百": 200}
    for s, n in words.items():
        assert val(spark, N.cn_to_int(L(s))) == (n,)
    assert val(spark, N.cn_to_int(L("三x"))) == (None,)
    a = "１０６台北市大安區（舊）新生南路三段１之２號5樓"
    assert val(spark, N.norm_address(L(a))) == ("臺北市大安區新生南路3段1之2號",)


def test_address_keys(spark):
    pairs = {
        "臺北市濟南路一段六號": "臺北市濟南路1段6號",
        "台北市中山北路２段44巷2號 3樓之1": "臺北市中山北路2段44巷2號",
        "40341臺中市西區五權路2-3號(社區活動中心)": "臺中市西區五權路2之3號",
        "五權路2~3號": "五權路2之3號",
        "中正路一百零八號": "中正路108號",
        "中正路二巷三弄五號": "中正路二巷三弄5號",
        "中山路12號（未關": "中山路12號",
        "鹿港鎮公所、圖書館": "鹿港鎮公所、圖書館",
        "十全二路": "十全二路",
        " ": "",
        None: "",
    }
    rows = spark.createDataFrame([(k, v) for k, v in pairs.items()], "a string, b string").select("a", "b", N.norm_address(F.col("a")).alias("k")).collect()
    assert [(r.a, r.k) for r in rows] == [(r.a, r.b) for r in rows]


def test_keys_of_schools_terms_and_names(spark):
    got = val(
        spark, X.norm_school(L("台北市松山社區大學")), X.norm_school(L("松山 社大")), X.norm_school(L("澎湖縣社區大學")), X.norm_school(L("澎湖社大")), X.norm_school(L("臺中市大里國民運動中心")), X.norm_school(L("東園樂齡學習中心")), X.norm_school(L("二甲市民學苑")), X.norm_school(L(None).cast("string")),
        X.norm_title(L("【11/18開課】抒壓玩水彩（六週）")), X.norm_title(L("英文/會話(A) 第二班")), X.term_key(L(115), L("秋"), L("x")), X.term_key(L(None).cast("int"), L("秋"), L("115 秋 季")), X.term_key(L(None).cast("int"), L(None).cast("string"), L(None).cast("string")),
        X.short_provider(L("臺中市五權社區大學")), X.short_provider(L("嘉義市嘉義市社區大學")), X.short_provider(L("雅藝職能技術顧問有限公司")), X.short_provider(L("財團法人台北市華夏婦女文教基金會")), X.short_provider(L("社區大學推廣中心")),
        X.course_slug_base(L("【新】[熱] 書法(一)"), L("松山社區大學")), X.course_slug_base(L("★"), L(None).cast("string")), X.venue_slug_base(L("財團法人 某某 館")), X.teacher_slug_base(L("王 小明"), L("松山社大")), R.is_placeholder(L(" 戶外教學")), R.is_placeholder(L("詳見官網")), R.is_placeholder(L(None).cast("string")), X.county_of(L("台北市 ")), X.county_of(L("其他")),
    )
    assert got == ("松山", "松山", "澎湖", "澎湖", "大里", "東園", "二甲市民學苑", "", "抒壓玩水彩", "英文/會話(A)第二班", "115秋", "115秋季", "", "五權社大", "嘉義市社大", "雅藝職能技術顧問", "華夏婦女文教基金會", "社區大學推廣中心", "書法一-松山社大", "課程", "某某館", "王小明-松山社大", True, False, True, "臺北市", None)


def test_dates(spark):
    t = L("2026-09-11")
    got = val(
        spark,
        D.season_of(L("2026-01-05")), D.season_of(L("2026-07-01")), D.bimonthly_term(L("2026-03-01")), D.roc_date(L("115.3.7")), D.roc_date(L("1150307")),
        D.ymd(L("2026/3/7")), D.ymd(L("0000-00-00")), D.status_of(L("2026-10-01"), L(None).cast("string"), t), D.has_ended(L(None).cast("string"), t),
        D.is_inverted(L("2026-02-01"), L("2026-01-01")), D.slot_kind(L(3), L("18:30")), D.slot_kind(L(6), L("09:00")), D.teacher_slot_kind(L(3), L(None).cast("string")),
        D.is_current(L("2026-08-01"), L("2026-09-01"), t), D.in_term_window(L("a"), L("2026-02-10"), {"a": [(101, 131)]}, [(201, 228)]),
    )
    assert got == ("冬季", "暑期", "115-02", "2026-03-07", "2026-03-07", "2026-03-07", None, "upcoming", False, True, "evening", "weekend", "daytime", True, False)


def test_geo(spark):
    lat, lng = val(spark, *G.tm2_to_wgs84(L(250000.0), L(2765000.0)))
    assert abs(lng - 121.0) < 1e-9 and 24.9 < lat < 25.1
    r = val(spark, G.resolve_coords(L(25.0), L(121.5)), G.resolve_coords(L(1.0), L(2.0)), G.resolve_coords(L(None).cast("double"), L(1.0)))
    assert (r[0].lat, r[0].lng, r[0].reason) == (25.0, 121.5, "swapped") and r[1].reason == "out of range" and r[2].lat is None
    assert abs(val(spark, G.haversine_km(L(25.0), L(121.0), L(26.0), L(121.0)))[0] - 111.195) < 0.01


def test_rules(spark):
    rules = [{"name": "yoga", "match": "瑜珈|yoga"}, {"name": "swim", "match": "泳", "exclude": "泳裝"}, {"name": "art", "match": "油畫", "category": "藝術", "category_match": "班"}]
    got = val(spark, R.labels(L("YOGA 泳裝班"), L("藝術類"), rules), R.classify(L("泳池"), [("泳", "w"), ("池", "p")]), S.is_bare_address(L("中正路12號")), S.is_bare_address(L("古坑鄉荷苞厝8號")), S.is_bare_address(L("館(12號")), R.is_free_now(L(True), L(None).cast("string")), R.is_free_now(L(None).cast("boolean"), L("open")), R.nearly_full(L("open"), L(3), L(20)), R.same_county(L(None), L("a")), R.place_like(L("臺北市")), R.noindex(L("<head><meta name=robots content=noindex></head>")), R.noindex(L("<head></head><meta name=robots content=noindex>")))
    assert got == (["yoga", "art"], "w", True, True, False, True, False, True, True, False, True, False)


def test_address_expressions_stay_small(spark):
    from weftline.operators import geocode as C

    row = spark.createDataFrame([("台中市西區五權路2-3號", "臺中市")], "a string, c string")
    for made in (N.norm_address(F.col("a")), C.clean_address(F.col("a"), F.col("c")), C.place_candidates(F.col("a")), C.school_keys(F.col("a"))):
        plan = row.select(made)._jdf.queryExecution().analyzed()
        assert plan.expressions().apply(0).collectLeaves().size() < 200


def test_title_keys_of_series(spark):
    same = ["瑜珈", "瑜珈（第3期開課）", "瑜珈第3梯次", "【10/5開課】瑜珈", "瑜珈 第 ３ 期", "瑜珈(一梯)"]
    got = spark.createDataFrame([(t,) for t in same], "t string").select(X.title_key(F.col("t"))).distinct().collect()
    assert [r[0] for r in got] == ["瑜珈"]
    assert val(spark, X.title_key(L("春季班A 三屆")), X.title_key(L(None).cast("string"))) == ("春季班a三屆", "")
