"""Source mappings over raw records made from the given tables: orders are courses, customers and suppliers places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.lineage import scratch
from ..sources import normalize as N
from ..sources.landed import observed
from .registry import read, registrar

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)

AT = "1996-06-01T08:00:00+08:00"


def _pick(key: Column, *values) -> Column:
    """One of several spellings by the key's remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _day(c: Column | str, shift: int = 0) -> Column:
    return F.date_format(F.date_add(c, shift), "yyyy-MM-dd")


def _orders(spark, d):
    o = read(spark, d, "orders")
    return o.withColumn("k", F.col("o_orderkey")).withColumn("day", _day("o_orderdate")).withColumn("id", F.col("o_orderkey").cast("string"))


def _flat(df, **paths):
    return df.select(F.col("_sourceRecordId").alias("record"), *[F.col(p).alias(n) for n, p in paths.items()])


_O = "o AS (SELECT *, o_orderkey AS k, o_orderkey::VARCHAR AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate - INTERVAL 30 DAY, '%Y-%m-%d') AS opens, strftime(o_orderdate - INTERVAL 5 DAY, '%Y-%m-%d') AS closes FROM orders)"
_WINDOW = "CASE WHEN c < '1996-06-01' THEN 'closed' WHEN p > '1996-06-01' THEN 'upcoming' WHEN p IS NOT NULL AND c IS NOT NULL THEN 'open' ELSE 'unknown' END"


@query(f"""
WITH {_O}, w AS (SELECT *, CASE WHEN k % 3 <> 1 THEN opens END AS p, CASE WHEN k % 4 <> 1 THEN closes END AS c FROM o)
SELECT id AS record, o_orderpriority AS title, day AS starts, {_WINDOW} AS status, p AS opens, CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 3)::DOUBLE END AS hours,
  (['臺北市信義路1號', '新竹市光復路2號', NULL, NULL, '新竹市九樓3樓'])[k % 5 + 1] AS address, (['street', 'street', 'district', 'city', 'street'])[k % 5 + 1] AS precision,
  CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE (o_custkey % 1000)::DOUBLE END AS price, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE (o_custkey % 1000 = 0)::INTEGER END AS free
FROM w WHERE k % 11 <> 0
""")
def source_job_training(spark, d):
    """Job training: status by the fetch day, doubled counties, counties that an address lacks."""
    o, k = _orders(spark, d), F.col("k")
    raw = o.select(
        F.when(k % 11 != 0, F.col("id")).otherwise(" ").alias("ID"), F.concat(F.lit("  "), "o_orderpriority", F.lit("　")).alias("Name"), F.lit("u").alias("TrainingUnit"), F.lit("").alias("BranchName"), F.lit(None).cast("string").alias("PlanName"),
        F.concat("day", F.lit("T09:00:00")).alias("TrainingStartDateTime"), F.lit("soon").alias("TrainingEndDateTime"), F.lit("").alias("TrainingTime"), (F.col("o_custkey") % 3).alias("THOURS"),
        F.when(k % 3 != 1, F.concat(_day("o_orderdate", -30), F.lit(" 00:00"))).alias("RegisterStartDateTime"), F.when(k % 4 != 1, _day("o_orderdate", -5)).alias("RegisterEndDateTime"), F.lit("30").alias("TNUM"), F.lit("https://x").alias("Url"),
        _pick(k, "臺北市臺北市信義路1號", "光復路2號", "某處", " ", "九樓3樓").alias("Address"), _pick(k, None, "新竹市", "新竹市", "新竹市", "新竹市").alias("CityName"), F.lit("there").alias("CourseLocation"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "0").otherwise((F.col("o_custkey") % 1000).cast("string")).alias("DEFSTDCOST"), F.lit("c").alias("Category"), F.lit("p").alias("SourcePrimaryKey"), F.lit("").alias("UpdateTime"),
    )
    return _flat(N.job_training(raw, AT), title="title", starts="schedule.startDate", status="enrollment.status", opens="enrollment.opensAt", hours="schedule.hours", address="location.address", precision="location.addressPrecision", price="price", free="isFree").withColumn("free", F.col("free").cast("int"))


@query(f"""
WITH {_O}, w AS (SELECT *, opens AS p, CASE WHEN k % 3 <> 1 THEN closes END AS c FROM o)
SELECT id AS record, 't' || o_custkey AS title, day AS starts, strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') AS ends, {_WINDOW} AS status, (['高雄市三民區建國路1號', '高雄市三民區建國路1號', NULL])[k % 3 + 1] AS address, (['street', 'street', 'district'])[k % 3 + 1] AS precision,
  (['2', NULL])[k % 2 + 1] AS term, CASE WHEN k % 2 = 0 THEN year(o_orderdate) - 1911 END AS term_year, ([1234.0, NULL, 0.0])[k % 3 + 1] AS price, 'aim' || chr(10) || 'one' || chr(10) || 'two' AS description
FROM w
""")
def source_pre_job_training(spark, d):
    """Pre-job training: dates padded and split at a tilde, the student's share, paragraphs."""
    o, k = _orders(spark, d), F.col("k")
    short = lambda c: F.date_format(c, "yyyy/M/d")
    raw = o.select(
        F.col("id").alias("課程編號"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("課程名稱"), F.lit("").alias("訓練單位名稱"), F.lit("b").alias("分署"), F.lit(None).cast("string").alias("單位名稱"),
        F.concat(short("o_orderdate"), F.lit(" ~ "), short(F.date_add("o_orderdate", 9))).alias("訓練期間"), F.concat(short(F.date_add("o_orderdate", -30)), F.when(k % 3 != 1, F.concat(F.lit("～"), short(F.date_add("o_orderdate", -5)))).otherwise("")).alias("報名期間"),
        F.lit("高雄市").alias("訓練縣市"), F.lit("三民區").alias("訓練區域"), _pick(k, "高雄市三民區建國路1號", "建國路1號", "某處").alias("訓練地址"), _pick(k, "補助：9 學員負擔：1,234 元", "免費", "學員負擔: 0").alias("經費"),
        _pick(k, "2", "x").alias("數量"), F.lit("").alias("訓練時段"), F.lit("0").alias("訓練時數"), F.lit("").alias("網址"), F.lit(" aim ").alias("訓練目標"), F.lit("one ^^ two^").alias("課程內容"),
    )
    return _flat(N.pre_job_training(raw, AT), title="title", starts="schedule.startDate", ends="schedule.endDate", status="enrollment.status", address="location.address", precision="location.addressPrecision", term="term.raw", term_year="term.year", price="price", description="description")


@query(f"""
WITH {_O}, w AS (SELECT *, CASE WHEN k % 5 <> 0 THEN opens END AS p, CASE WHEN k % 4 <> 2 THEN closes END AS c FROM o)
SELECT CASE WHEN k % 2 = 0 THEN 'c' || id ELSE 'https://f/' || id END AS record, o_orderpriority AS title, {_WINDOW} AS status, p AS opens, c AS closes, CASE WHEN k % 4 = 2 THEN '額滿為止' END AS rule FROM w WHERE k % 7 <> 0
""")
def source_nature_courses(spark, d):
    """Nature education: codes out of addresses, a closing rule that is no date."""
    o, k = _orders(spark, d), F.col("k")
    url = F.when(k % 2 == 0, F.concat(F.lit("https://f/x?a=1&ID=c"), "id", F.lit("&b=2"))).otherwise(F.concat(F.lit("https://f/"), "id"))
    raw = o.select(url.alias("url"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("NAduName"), F.lit("center").alias("AduName"), F.when(k % 5 != 0, _day("o_orderdate", -30)).otherwise("1996/1/1").alias("onAskStartDay"), F.when(k % 4 != 2, _day("o_orderdate", -5)).otherwise("額滿為止").alias("onAskEnd"))
    return _flat(N.nature_courses(raw, AT), title="title", status="enrollment.status", opens="enrollment.opensAt", closes="enrollment.closesAt", rule="enrollment.closesRuleRaw")


@query(f"""
WITH {_O}
SELECT (['臺北市大安區老人中心', '別處'])[k % 2 + 1] || '|' || o_orderpriority || '|' || CASE WHEN k % 3 = 0 THEN '' ELSE day END || '|' AS record, o_orderpriority AS title, CASE WHEN k % 3 <> 0 THEN day END AS starts,
  (['大安區', NULL])[k % 2 + 1] AS district, ([20, NULL, NULL, 7])[k % 4 + 1]::INTEGER AS capacity, CASE WHEN k % 3 <> 0 THEN year(o_orderdate) - 1911 END AS term_year FROM o
""")
def source_senior_points(spark, d):
    """Senior centres: a record id of place, title and dates; districts of one city."""
    o, k = _orders(spark, d), F.col("k")
    raw = o.select(_pick(k, "臺北市大安區老人中心", "別處").alias("地點"), F.col("o_orderpriority").alias("課程名稱"), F.when(k % 3 == 0, "未定").otherwise(F.col("day")).alias("開課起始日期"), F.lit("").alias("開課結束日期"), _pick(k, "20", "0", "x", "7").alias("人數"), F.lit("").alias("電話"), F.lit(None).cast("string").alias("授課老師"))
    return _flat(N.senior_points(raw, AT), title="title", starts="schedule.startDate", district="location.district", capacity="enrollment.capacity", term_year="term.year")


@query(f"""
WITH {_O}
SELECT ('s' || k % 3) || ':' || id AS record, 'course' AS title, CASE k % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'open' ELSE 'unknown' END AS status, (['Pool', 's1', 'Gym'])[k % 3 + 1] || ' R1' AS venue, (['臺北市', NULL, '新北市'])[k % 3 + 1] AS city,
  CASE WHEN k % 4 <> 3 THEN (k % 4) + 1 END AS weekday, CASE WHEN k % 4 <> 3 THEN '09:00' END AS start, (year(o_orderdate) - 1911) || lpad((floor((month(o_orderdate) - 1) / 2) + 1)::INTEGER::VARCHAR, 2, '0') AS term
FROM o WHERE k % 13 <> 0
""")
def source_seat_bookings(spark, d):
    """Bookings with free seats, joined with their sites; two-month terms."""
    o, k = _orders(spark, d), F.col("k")
    raw = o.select(
        F.when(k % 13 != 0, F.col("id")).alias("courseCode"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("_site"), F.lit(" course ").alias("courseName"), F.lit("").alias("_categoryName"), F.lit("op").alias("_operator"),
        F.col("day").alias("dateBegin"), F.lit("").alias("dateEnd"), _pick(k, "一", "二", "三", "").alias("weekday"), _pick(k, "09:00", "09:00", "09:00", "").alias("timeBegin"), F.lit(None).cast("string").alias("timeEnd"),
        F.when(k % 3 == 0, "0").when(k % 3 == 1, "5").otherwise("-").alias("available"), F.lit("9").alias("capacity"), F.lit("R1").alias("classroom"), F.lit("").alias("teacher"),
    )
    sites = spark.sql("SELECT * FROM VALUES ('s0', 'Pool', '臺北市', '大安區', 'a.b'), ('s2', 'Gym', '新北市', '板橋區', NULL) AS t(_site, venueName, city, district, host)")
    found = N.seat_bookings(raw, sites, AT).withColumn("slot", F.get("schedule.slots", F.lit(0)))
    return _flat(found, title="title", status="enrollment.status", venue="location.venueNameRaw", city="location.city", weekday="slot.weekday", start="slot.startTime", term="term.raw")


@query(f"""
WITH {_O}
SELECT 'l1:' || id AS record, (['114_03 游泳 7:30', 'NEW 11402瑜珈 18:05', '桌球'])[k % 3 + 1] AS title, (['114_03', '114_02', NULL])[k % 3 + 1] AS term, ([3, 2, NULL])[k % 3 + 1]::INTEGER AS term_no, (['07:30', '18:05', NULL])[k % 3 + 1] AS start, (['臺中市', NULL])[k % 2 + 1] AS city,
  CASE WHEN k % 4 = 3 THEN 'unknown' WHEN 12 - k % 15 <= 0 THEN 'full' ELSE 'open' END AS status, CASE WHEN k % 4 <> 3 THEN greatest(0, 12 - k % 15) END AS available, ([1200.0, NULL])[k % 2 + 1] AS price, (['$1,200', NULL])[k % 2 + 1] AS price_text
FROM o
""")
def source_titled_listing(spark, d):
    """Term and time out of titles, seats out of enrolled and capacity."""
    o, k = _orders(spark, d), F.col("k")
    raw = o.select(
        F.col("id").alias("ccid"), F.lit("l1").alias("_lid"), F.lit("site").alias("_site"), _pick(k, "114_03 游泳 7:30", "NEW 11402瑜珈 18:05", " 桌球").alias("title"), F.when(k % 4 != 3, 12).otherwise(0).alias("capacity"), (k % 15).cast("int").alias("enrolled"),
        _pick(k, "[404]台中市北區1號", " ").alias("_address"), _pick(k, "$1,200", "免費").alias("priceText"), F.array(F.lit(0), F.lit(3)).alias("weekDays"), F.lit("").alias("_categoryName"), F.lit("").alias("teacher"), F.lit("").alias("place"),
    )
    found = N.titled_listing(raw, AT).withColumn("slot", F.get("schedule.slots", F.lit(0)))
    return _flat(found, title="title", term="term.raw", term_no="term.termNo", start="slot.startTime", city="location.city", status="enrollment.status", available="enrollment.available", price="price", price_text="priceText")


def _portal(spark, d, mapping):
    o, k = _orders(spark, d), F.col("k")
    raw = o.select(
        F.col("id").alias("courseId"), F.col("o_orderpriority").alias("courseName"), F.lit("school").alias("school"), F.lit("114-1").alias("_semester"), _pick(k, "114 年度  第 2 學期", "暑期").alias("_semesterLabel"), _pick(k, "星期三、星期五 晚上", "星期日", "另定").alias("timeText"),
        _pick(k, "招生中", "額滿", "停召", "?").alias("statusText"), F.when(k % 5 != 4, 20).alias("capacity"), F.when(k % 2 == 0, 20).otherwise(5).alias("enrolled"), _pick(k, "tag", "").alias("tagText"), F.lit("").alias("discountText"),
    )
    found = mapping(raw, AT).withColumn("days", F.array_join(F.transform("schedule.slots", lambda s: s["weekday"].cast("string")), ","))
    return _flat(found, title="title", days="days", status="enrollment.status", available="enrollment.available", season="term.season", term="term.raw", url="sourceUrl", per_week="schedule.sessionsPerWeek")


_PORTAL = """
WITH {o}
SELECT '114-1:' || id AS record, o_orderpriority AS title, ({days})[k % 3 + 1] AS days, CASE WHEN k % 4 = 0 AND k % 5 <> 4 THEN 'full' ELSE (['open', 'full', 'cancelled', 'unknown'])[k % 4 + 1] END AS status, CASE WHEN k % 5 <> 4 THEN CASE WHEN k % 2 = 0 THEN 0 ELSE 15 END END AS available,
  (['autumn', NULL])[k % 2 + 1] AS season, (['114 年度 第 2 學期', NULL])[k % 2 + 1] AS term, '{site}' || id AS url, {per_week} AS per_week FROM o
"""


@query(_PORTAL.format(o=_O, days="['3', '7', '']", site="https://cc.tc.edu.tw/view/", per_week="NULL::INTEGER"))
def source_taichung_portal(spark, d):
    """A portal that names one weekday."""
    return _portal(spark, d, N.taichung_portal)


@query(_PORTAL.format(o=_O, days="['3,5', '7', '']", site="https://hualien.cloudschool.com.tw/view/", per_week="([2, 1, NULL])[k % 3 + 1]::INTEGER"))
def source_hualien_portal(spark, d):
    """A portal where every weekday named is a slot."""
    return _portal(spark, d, N.hualien_portal)


@query("""
WITH c AS (SELECT *, c_custkey AS k FROM customer),
v AS (SELECT k, 'v' || k % 50 AS name, (['臺北市', '新竹縣'])[k % 2 + 1] AS city, (['臺北市中山路1號', NULL])[k % 2 + 1] AS address, c_mktsegment AS facility, CASE WHEN k % 3 = 0 THEN 25.0 END AS lat FROM c WHERE k % 9 <> 0)
SELECT city || '|' || name || '|' || coalesce(address, '') AS record, name, city, address, array_to_string(list_sort(list(DISTINCT facility)), ',') AS facilities, arg_min_null(lat, k) AS lat FROM v GROUP BY name, city, address
""")
def source_sports_venues(spark, d):
    """The venue register: rows of facilities become venues; the first row's coordinates, in range or none."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    raw = c.select(
        k.alias("at"), F.when(k % 9 != 0, F.concat(F.lit("v"), (k % 50).cast("string"))).otherwise("NULL").alias("場館名稱"), _pick(k, "10001台北市中山路1號", "NULL").alias("地址"), _pick(k, "x", "10004").alias("縣市"), F.col("c_mktsegment").alias("場館分類"),
        F.lit("NULL").alias("場館隸屬機關屬性"), F.lit("").alias("行政區"), F.lit("").alias("場館實際管理人電話"), F.lit("NULL").alias("場館官方網站"), F.when(k % 3 == 0, "25.0").otherwise("99").alias("緯度"), F.lit("121.5").alias("經度"),
    )
    return _flat(N.sports_venues(raw, AT, "at").withColumn("all", F.array_join("facilities", ",")), name="name", city="city", address="address", facilities="all", lat="lat")


@query("""
WITH c AS (SELECT *, c_custkey AS k FROM customer)
SELECT (['臺北市', '花蓮縣'])[k % 2 + 1] || '|site' || k % 40 || '|' || (['中山路1號', ''])[k % 2 + 1] AS record, 'site' || k % 40 AS name, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS used_by, max((110 + k % 5)::VARCHAR) AS latest FROM c GROUP BY k % 2, k % 40
""")
def source_college_sites(spark, d):
    """College sites: the schools that use a site, and its latest year."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    raw = c.select(k.alias("at"), F.concat(F.lit("site"), (k % 40).cast("string")).alias("據點名稱"), _pick(k, "[100]中山路1號", "").alias("據點地址"), _pick(k, "臺北市", "花蓮縣").alias("縣市別"), F.col("c_mktsegment").alias("社區大學名稱"), (k % 5 + 110).cast("string").alias("年度"))
    return _flat(N.college_sites(raw, AT, "at").withColumn("all", F.array_join("usedByRaw", ",")), name="name", used_by="all", latest="latestYear")


@query("""
WITH s AS (SELECT *, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nth FROM supplier WHERE s_suppkey % 6 <> 0)
SELECT '縣' || s_nationkey || '|中心' AS record, '中心' AS name, '縣' || s_nationkey AS city, k || '路1號' AS address FROM s WHERE nth = 1
""")
def source_senior_centers(spark, d):
    """Senior learning centres: the first row of each city and name."""
    s, k = read(spark, d, "supplier"), F.col("s_suppkey")
    raw = s.select(k.alias("at"), F.when(k % 6 != 0, F.concat(F.lit("縣"), F.col("s_nationkey").cast("string"))).alias("縣市"), F.lit("中心").alias("樂齡中心名稱"), F.lit("").alias("鄉鎮市區名稱"), F.concat(F.lit("[123]"), k.cast("string"), F.lit("路1號")).alias("中心地址"), F.lit("").alias("中心電話"))
    return _flat(N.senior_centers(raw, AT, "at"), name="name", city="city", address="address")


@query("""
WITH s AS (SELECT *, s_suppkey AS k, 'f' || s_suppkey % 2 AS file, s_nationkey::VARCHAR AS code FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY file, code ORDER BY k % 4 DESC, k) AS nth FROM s)
SELECT file || ':' || code AS record, '臺學' || k AS name, '臺東縣中華路' || k || '號' AS address, '臺東縣' AS city, CASE WHEN k % 2 = 0 THEN 'http://s' END AS website FROM r WHERE nth = 1 AND k % 3 <> 0
""")
def source_school_directory(spark, d):
    """Schools: each code's latest year, and only addresses with a house number."""
    s, k = read(spark, d, "supplier"), F.col("s_suppkey")
    raw = s.select(k.alias("at"), F.concat(F.lit("f"), (k % 2).cast("string")).alias("_file"), F.lit("國小").alias("_kind"), F.col("s_nationkey").cast("string").alias("代碼"), F.concat(F.lit("台學"), k.cast("string")).alias("學校名稱"), (k % 4).cast("string").alias("學年度"), F.concat(F.lit("[950]台東縣中華路"), k.cast("string"), F.when(k % 3 != 0, "號").otherwise("")).alias("地址"), _pick(k, "臺東縣", "").alias("縣市名稱"), _pick(k, "http://s", "none").alias("網址"))
    return _flat(N.school_directory(raw, AT, "at"), name="name", address="address", city="city", website="website")


@query("""
WITH s AS (SELECT *, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nth FROM supplier)
SELECT 'c' || s_nationkey AS record, (['信義區', NULL])[k % 2 + 1] AS district, ([25.03, NULL, NULL])[k % 3 + 1] AS lat, ([121.5, NULL, NULL])[k % 3 + 1] AS lng FROM s WHERE nth = 1
""")
def source_city_sports_centers(spark, d):
    """One city's sports centres: coordinates in pairs or not at all."""
    s, k = read(spark, d, "supplier"), F.col("s_suppkey")
    raw = s.select(k.alias("at"), F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("名稱"), _pick(k, "臺北市信義區1號", "別處").alias("地址"), _pick(k, "25.03", "0", "25.03").alias("緯度"), _pick(k, "121.5", "0", "").alias("經度"), F.lit("").alias("電話"), F.lit("").alias("網址"))
    return _flat(N.city_sports_centers(raw, AT, "at"), district="district", lat="lat", lng="lng")


@query(f"""
WITH {_O}
SELECT 'l:' || id AS record, o_orderpriority AS title, 'day' || year(o_orderdate) AS landed, CASE WHEN k % 4 = 0 THEN 'cancelled' ELSE 'open' END AS status, CASE WHEN k % 5 <> 4 THEN 20 - k % 15 END AS available FROM o WHERE year(o_orderdate) >= 1996
""")
def landed_source(spark, d):
    """Records landed as JSON lines by day, read back by the data source from some days on, and mapped."""
    o, k = _orders(spark, d), F.col("k")
    raw = o.select(
        F.concat(F.lit("day"), F.year("o_orderdate").cast("string")).alias("day"), F.col("id").alias("courseId"), F.col("o_orderpriority").alias("courseName"), F.lit("l").alias("_semester"), F.concat(F.lit("day"), F.year("o_orderdate").cast("string")).alias("school"),
        F.when(k % 4 == 0, "停開").otherwise("公布").alias("statusText"), F.when(k % 5 != 4, 20).alias("capacity"), (k % 15).cast("string").alias("enrolled"), F.lit("星期一").alias("timeText"),
    )
    root = scratch(spark, "landed")
    raw.write.partitionBy("day").json(f"{root}/raw")
    _by_day(spark, f"{root}/raw", f"{root}/hualien-cc")
    found = observed(spark, root, "hualien-cc", AT, since="day1996")
    return _flat(found, title="title", landed="provider.nameRaw", status="enrollment.status", available="enrollment.available")


def _by_day(spark, made: str, where: str) -> None:
    """Partition folders "day=x" renamed to the layout of landed files."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(made).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(where))
    for s in fs.listStatus(path(made)):
        name = s.getPath().getName()
        if name.startswith("day="):
            fs.rename(s.getPath(), path(f"{where}/{name[4:]}"))
