"""Hubs, city facts, shown names, and addresses for a geocoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as V
from ..functions.numerals import norm_address
from ..operators import geocode as G
from ..operators import hubs as H
from .registry import read, registrar

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)

_JOINED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
#: Titles that orders stand for, by their key.
TITLES = ("樂齡瑜珈", "中高齡就業", "照顧服務員", "兒童繪畫", "書法入門", "堆高機操作", "銀髮合唱")
KINDS = ("senior-center", "vocational", "community-college", "sports-center")
_TITLE = "list_extract([" + ", ".join(f"'{t}'" for t in TITLES) + "], CAST(o_orderkey % 7 AS INTEGER) + 1)"
_KIND = "list_extract([" + ", ".join(f"'{t}'" for t in KINDS) + "], CAST(o_custkey % 4 AS INTEGER) + 1)"


def _placed(spark, d):
    o, c, n = read(spark, d, "orders"), read(spark, d, "customer"), read(spark, d, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)


def _pick(values, key: str):
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))


@query(f"""
WITH m AS (SELECT o_orderkey, {_TITLE} AS title, {_KIND} AS kind, CASE WHEN o_custkey % 3 = 0 THEN '樂齡' ELSE '一般' END AS audience, CASE WHEN o_custkey % 5 = 0 THEN '產業人才投資方案' WHEN o_custkey % 5 = 1 THEN '失業者職前訓練' WHEN o_custkey % 5 = 2 THEN '' END AS plan,
  CASE WHEN o_orderkey % 2 = 0 THEN 'mol-6060' ELSE 'taiwanjobs' END AS src, CASE WHEN o_orderkey % 11 = 0 THEN '結訓後輔導考取乙級證照' ELSE '一般說明' END AS info FROM orders)
SELECT o_orderkey, CASE WHEN kind = 'senior-center' THEN true WHEN kind = 'vocational' THEN regexp_matches(title, '{H.SENIOR_JOB}') ELSE regexp_matches(title, '{H.SENIOR_TITLE}') OR audience LIKE '樂齡%' END AS senior,
  regexp_matches(title, '證照|照顧服務員|堆高機') OR regexp_matches(info, '輔導考取') AS cert, regexp_matches(title, '兒童') AS kids,
  concat_ws('|', CASE WHEN plan = '產業人才投資方案' THEN '產投' END, CASE WHEN plan LIKE '%職前%' OR (kind = 'vocational' AND coalesce(plan, '') = '' AND src = 'mol-6060') THEN '職前訓練' END) AS programs FROM m
""")
def hub_members(spark, d):
    """Which hubs each listing belongs to: seniors, certificates, children, training programmes."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    title, kind = _pick(TITLES, "o_orderkey"), _pick(KINDS, "o_custkey")
    plan = F.when(F.col("o_custkey") % 5 == 0, H.JOB_PLAN).when(F.col("o_custkey") % 5 == 1, "失業者職前訓練").when(F.col("o_custkey") % 5 == 2, "")
    sources = F.array(F.when(F.col("o_orderkey") % 2 == 0, "mol-6060").otherwise("taiwanjobs"))
    info = F.when(F.col("o_orderkey") % 11 == 0, "結訓後輔導考取乙級證照").otherwise("一般說明")
    audience = F.when(F.col("o_custkey") % 3 == 0, "樂齡").otherwise("一般")
    return o.select("o_orderkey", H.is_senior(kind, title, audience).alias("senior"), H.is_cert(title, info).alias("cert"), H.is_kids(title).alias("kids"), F.array_join(H.program_of(kind, plan, sources), "|").alias("programs"))


@query(f"""
WITH m AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE n_name END AS city, o_orderstatus = 'O' AS o FROM {_JOINED} WHERE o_orderpriority LIKE '1%' AND o_orderstatus <> 'P')
SELECT 'all' AS level, NULL AS city, count(*) AS n, coalesce(sum(o::INT), 0)::BIGINT AS n_open FROM m
UNION ALL SELECT 'city', city, count(*), sum(o::INT)::BIGINT FROM m WHERE city IS NOT NULL GROUP BY city HAVING count(*) >= 8
""")
def hub_by_city(spark, d):
    """A hub's members, open ones, and the cities with enough of them."""
    rows = _placed(spark, d).withColumn("city", F.when(F.col("o_orderkey") % 13 != 0, F.col("n_name")))
    return H.hub(rows, F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") != "P"), "city", F.col("o_orderstatus") == "O")


@query(f"""
WITH m AS (SELECT n_name AS city, c_mktsegment AS k, strftime(o_orderdate, '%Y-%m-%d') AS s, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS d, o_orderstatus = 'O' AS o, o_totalprice > 100000 AS c FROM {_JOINED}),
f AS (SELECT city, 'kind' AS fact, k AS key, c, o FROM m WHERE o AND k IN ('BUILDING', 'MACHINERY', 'FURNITURE') UNION ALL SELECT city, 'month', left(s, 7), c, o FROM m WHERE o AND s >= '1996-06-01'
  UNION ALL SELECT city, 'district', d, c, o FROM m WHERE d <> '' UNION ALL SELECT city, 'none', '', c, o FROM m WHERE o AND d = '')
SELECT city, fact, key, count(*) AS n, count(*) FILTER (c) AS n_current, count(*) FILTER (o) AS n_open FROM f GROUP BY ALL
""")
def city_facts(spark, d):
    """Open listings by kind and starting month, and all by district, for each city."""
    rows = _placed(spark, d).withColumn("start", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("district", F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderpriority")))
    return H.city_facts(rows, "n_name", "c_mktsegment", "start", "district", F.col("o_orderstatus") == "O", F.col("o_totalprice") > 100000, F.lit("1996-06-01"), ["BUILDING", "MACHINERY", "FURNITURE"])


@query(f"""
WITH m AS (SELECT n_name, o_orderpriority AS a, o_orderstatus = 'O' AS o, o_totalprice > 100000 AS c FROM {_JOINED}),
k AS (SELECT n_name, a, row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC, a) AS nth FROM m WHERE o GROUP BY n_name, a),
t AS (SELECT n_name, string_agg(a, '|' ORDER BY nth) AS activities FROM k WHERE nth <= 3 GROUP BY 1)
SELECT n_name, count(*) AS n, count(*) FILTER (c) AS n_current, count(*) FILTER (o) AS n_open, coalesce(max(activities), '') AS activities FROM m LEFT JOIN t USING (n_name) GROUP BY n_name
""")
def compare_cities(spark, d):
    """Cities side by side, with their three most frequent open activities."""
    return H.compare_cities(_placed(spark, d), "n_name", "o_orderpriority", F.col("o_orderstatus") == "O", F.col("o_totalprice") > 100000)


@query(f"""
WITH c AS (SELECT n_name, o_orderstatus, c_mktsegment AS p, count(*) AS k, count(*) FILTER ({_KIND} = 'sports-center') AS n FROM {_JOINED} WHERE o_orderkey % 10 = 0 OR c_mktsegment = 'BUILDING' GROUP BY ALL),
b AS (SELECT n_name, o_orderstatus, max(n) AS n, max_by(p, (n, p)) AS p, sum(k)::BIGINT AS total FROM c GROUP BY 1, 2)
SELECT n_name, o_orderstatus, p AS c_mktsegment, n, total FROM b WHERE n > 0 AND n >= total * 0.15
""")
def dominant_center(spark, d):
    """Pages of which one sports centre holds a given share."""
    rows = _placed(spark, d).where("o_orderkey % 10 = 0 or c_mktsegment = 'BUILDING'").withColumn("kind", _pick(KINDS, "o_custkey"))
    return H.dominant_center(rows, ["n_name", "o_orderstatus"], "kind", "c_mktsegment", 0.15)


_CITY = "CASE c_nationkey % 4 WHEN 0 THEN '臺北市' WHEN 1 THEN '新竹縣' WHEN 2 THEN '' ELSE NULL END"
_WHO = "CASE o_custkey % 3 WHEN 0 THEN '台北市松山社大' WHEN 1 THEN c_name ELSE NULL END"
_SEASON = "year(o_orderdate) || ' ' || CASE WHEN month(o_orderdate) = 1 THEN '冬季' WHEN month(o_orderdate) <= 6 THEN '春季' WHEN month(o_orderdate) <= 8 THEN '暑期' ELSE '秋季' END"


@query(f"""
WITH m AS (SELECT o_orderkey, o_orderpriority AS t, coalesce({_WHO}, '') AS p, {_CITY} AS city, CASE WHEN o_orderkey % 9 <> 0 THEN {_SEASON} END AS s, dayofweek(o_orderdate) AS w FROM {_JOINED}),
k AS (SELECT *, count(*) OVER (PARTITION BY t, p, coalesce(s, '')) > 1 AS collide FROM m)
SELECT o_orderkey, t || CASE WHEN p <> '' THEN '｜' || p ELSE '' END
  || CASE WHEN coalesce(city, '') = '' OR contains(replace(p, '臺', '台'), CASE city WHEN '臺北市' THEN '台北' ELSE '新竹' END) THEN '' WHEN p <> '' THEN '（' || CASE city WHEN '臺北市' THEN '台北' ELSE '新竹縣' END || '）' ELSE '｜' || city END
  || coalesce(' ' || s, '') || CASE WHEN collide THEN ' 週' || w ELSE '' END AS title FROM k
""")
def course_titles(spark, d):
    """Titles with provider, place and season; with the time where they would collide."""
    who = F.when(F.col("o_custkey") % 3 == 0, "台北市松山社大").when(F.col("o_custkey") % 3 == 1, F.col("c_name"))
    city = F.when(F.col("c_nationkey") % 4 == 0, "臺北市").when(F.col("c_nationkey") % 4 == 1, "新竹縣").when(F.col("c_nationkey") % 4 == 2, "")
    rows = _placed(spark, d).select("o_orderkey", F.col("o_orderpriority").alias("t"), F.coalesce(who, F.lit("")).alias("p"), city.alias("city"), F.when(F.col("o_orderkey") % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("start"), (F.dayofweek("o_orderdate") - 1).alias("w"))
    rows = H.with_collisions(rows.withColumn("s", V.year_season(F.col("start"))), ["t", "p", "s"])
    return rows.select("o_orderkey", V.course_title(F.col("t"), F.col("p"), F.col("city"), F.col("start"), F.concat(F.lit("週"), F.col("w").cast("string")), F.col("collide")).alias("title"))


@query("""
WITH v AS (SELECT o_custkey, o_orderpriority AS name, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT o_custkey, list({'name': name, 'n': n} ORDER BY n DESC, name) AS ps, sum(n) AS total FROM v GROUP BY 1),
m AS (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN '中正路' || o_custkey || '號' ELSE '活動中心' || o_custkey || '號館' END AS name, CASE WHEN o_custkey % 10 = 0 THEN '松山館' END AS o FROM p)
SELECT o_custkey, CASE WHEN o IS NOT NULL THEN o || CASE WHEN o_custkey % 3 = 0 THEN '（' || name || '）' ELSE '' END WHEN o_custkey % 3 <> 0 THEN name
  WHEN ps[1].n >= total * 0.6 THEN name || '（' || ps[1].name || '上課地點）' WHEN len(ps) > 2 THEN name || '（' || ps[1].name || '、' || ps[2].name || '等 ' || len(ps) || ' 個單位的上課地點）' ELSE name || '（' || ps[1].name || '、' || ps[2].name || '的上課地點）' END AS heading FROM m
""")
def venue_headings(spark, d):
    """What a venue is called: an override, its name, or its address with who teaches there."""
    counts = read(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "name", "n"))).alias("ps"), F.sum("n").alias("total"))
    key = F.col("o_custkey").cast("string")
    name = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("中正路"), key, F.lit("號"))).otherwise(F.concat(F.lit("活動中心"), key, F.lit("號館")))
    return rows.select("o_custkey", V.venue_heading(name, F.when(F.col("o_custkey") % 10 == 0, "松山館"), F.col("ps"), F.col("total")).alias("heading"))


@query("""
WITH g AS (SELECT o_custkey, count(*) FILTER (dayofweek(o_orderdate) IN (0, 6)) AS we, count(*) FILTER (dayofweek(o_orderdate) BETWEEN 1 AND 5 AND o_orderkey % 3 = 0) AS ev, count(*) FILTER (dayofweek(o_orderdate) BETWEEN 1 AND 5 AND o_orderkey % 3 = 1) AS da,
  count(*) FILTER (o_orderkey % 4 <> 0) AS priced, CAST(min(floor(o_totalprice)) FILTER (o_orderkey % 4 <> 0) AS BIGINT) AS lo, CAST(max(floor(o_totalprice)) FILTER (o_orderkey % 4 <> 0) AS BIGINT) AS hi, count(*) FILTER (o_orderkey % 4 = 0) AS free FROM orders GROUP BY 1)
SELECT o_custkey, concat_ws('，', nullif(concat_ws('、', CASE WHEN we > 0 THEN '週末 ' || we || ' 門' END, CASE WHEN ev > 0 THEN '平日晚上 ' || ev || ' 門' END, CASE WHEN da > 0 THEN '平日白天 ' || da || ' 門' END), ''),
  CASE WHEN priced > 0 THEN '有標價的 ' || priced || ' 門 ' || CASE WHEN lo = hi THEN format('{:,}', lo) || ' 元' ELSE format('{:,}', lo) || '–' || format('{:,}', hi) || ' 元' END END, CASE WHEN free > 0 THEN '免費 ' || free || ' 門' END) AS blurb FROM g
""")
def facts_blurbs(spark, d):
    """One phrase of facts for each provider."""
    o = read(spark, d, "orders").withColumn("w", F.weekday("o_orderdate"))
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    g = o.groupBy("o_custkey").agg(
        F.count_if(F.col("w") >= 5).alias("we"), F.count_if((F.col("w") < 5) & (k % 3 == 0)).alias("ev"), F.count_if((F.col("w") < 5) & (k % 3 == 1)).alias("da"),
        F.count_if(k % 4 != 0).alias("priced"), F.min(F.when(k % 4 != 0, price)).alias("lo"), F.max(F.when(k % 4 != 0, price)).alias("hi"), F.count_if(k % 4 == 0).alias("free"),
    )
    return g.select("o_custkey", V.facts_blurb({"weekend": F.col("we"), "evening": F.col("ev"), "daytime": F.col("da")}, F.col("priced"), F.col("lo"), F.col("hi"), F.col("free")).alias("blurb"))


@query("""
WITH m AS (SELECT o_orderkey, o_custkey, year(o_orderdate) - 1895 AS y, CASE WHEN o_orderkey % 5 = 0 THEN 1.5 ELSE quarter(o_orderdate) END AS t FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC, t DESC, o_orderkey) AS k FROM m)
SELECT o_orderkey, o_custkey, y AS term_year, t::DOUBLE AS term_no FROM r WHERE k <= 2
""")
def latest_terms(spark, d):
    """Each provider's two latest listings by the rank of their semester labels."""
    o = read(spark, d, "orders")
    label = F.concat((F.year("o_orderdate") - 1895).cast("string"), F.when(F.col("o_orderkey") % 5 == 0, "年暑期第1學期").when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("年第"), F.translate(F.quarter("o_orderdate").cast("string"), "1234", "一二三四"), F.lit("學期"))).otherwise(F.concat(F.lit("-"), F.quarter("o_orderdate").cast("string"))))
    rows = o.select("o_orderkey", "o_custkey", V.semester_rank(label).alias("rank"))
    return H.last_terms(rows, "o_custkey", F.col("rank"), "o_orderkey", 2).select("o_orderkey", "o_custkey", F.col("rank.year").alias("term_year"), F.col("rank.term").alias("term_no"))


@query("""
WITH n AS (SELECT DISTINCT right(s_name, 3) AS ending FROM supplier UNION SELECT DISTINCT right(s_name, 4) FROM supplier)
SELECT ending, min(c_name) AS c_name FROM n JOIN customer ON ends_with(c_name, ending) GROUP BY ending HAVING count(DISTINCT c_name) = 1
""")
def unique_suffix(spark, d):
    """Endings that lead to exactly one name."""
    s = read(spark, d, "supplier")
    names = s.select(F.right("s_name", F.lit(3)).alias("ending")).union(s.select(F.right("s_name", F.lit(4)).alias("ending"))).distinct()
    return H.unique_suffix(names, "ending", read(spark, d, "customer").select("c_name"), "c_name")


@query("""
WITH a AS (SELECT o_custkey, o_orderpriority AS raw, count(*) AS n, min(o_orderkey) AS seen FROM orders GROUP BY ALL), b AS (SELECT o_custkey, o_orderstatus AS src, count(*) AS n, min(o_orderkey) AS seen FROM orders GROUP BY ALL),
x AS (SELECT o_custkey, arg_max(raw, n * 1000000000 - seen) AS raw FROM a GROUP BY 1), y AS (SELECT o_custkey, arg_max(src, n * 1000000000 - seen) AS source FROM b GROUP BY 1)
SELECT o.o_custkey, count(*) AS n, bool_or(o_totalprice > 200000) AS located, max(raw) AS raw, max(source) AS source FROM orders o JOIN x ON x.o_custkey = o.o_custkey JOIN y ON y.o_custkey = o.o_custkey GROUP BY o.o_custkey
""")
def address_rollup(spark, d):
    """The most frequent spelling and source of each key, and whether any row has coordinates."""
    return G.address_rollup(read(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderkey", F.col("o_totalprice") > 200000)


@query("""
SELECT c_nationkey, min(CASE WHEN c_custkey % 17 = 0 THEN 0 WHEN c_custkey % 5 = 0 THEN 1 ELSE 2 END) AS tier, sum(c_custkey)::BIGINT AS courses FROM customer WHERE c_acctbal > 0 GROUP BY 1
""")
def upload_order(spark, d):
    """What is sent to a geocoder first."""
    c = read(spark, d, "customer").where("c_acctbal > 0")
    origin = F.when(F.col("c_custkey") % 17 == 0, "derived").when(F.col("c_custkey") % 5 == 0, "registry")
    return G.upload_order(c, "c_nationkey", origin, "c_custkey")


_DIGITS = "一二三四五六七八九"


def _chinese(n):
    """A number from 10 to 99 in Chinese numerals."""
    digit = lambda k: F.substring(F.lit(_DIGITS), k.cast("int"), F.lit(1))
    tens, ones = F.floor(n / 10), n % 10
    return F.concat(F.when(tens > 1, digit(tens)).otherwise(F.lit("")), F.lit("十"), F.when(ones > 0, digit(ones)).otherwise(F.lit("")))


@query("""
SELECT c_custkey, '臺北市中山北路' || (c_custkey % 9 + 1) || '段' || (c_custkey % 90 + 10) || '號' AS key_of_numerals, '臺中市西區五權路' || (c_custkey % 50 + 1) || '之' || (c_custkey % 7 + 1) || '號' AS key_of_dashes,
  '臺南市東區林森路' || (c_custkey % 9 + 1) || '段' || (c_custkey % 90 + 10) || '號' AS cleaned, CASE WHEN c_custkey % 2 = 0 THEN '高雄市三民區建國路' || c_custkey || '號' END AS cleaned_or_not FROM customer
""")
def address_keys(spark, d):
    """Address keys and postal addresses out of several spellings."""
    k = F.col("c_custkey")
    section = F.substring(F.lit(_DIGITS), (k % 9 + 1).cast("int"), F.lit(1))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return read(spark, d, "customer").select(
        "c_custkey",
        norm_address(text("１０６台北市（舊）中山北路", section, "段 ", _chinese(k % 90 + 10), "號3樓")).alias("key_of_numerals"),
        norm_address(text("403台中市西區五權路", k % 50 + 1, "-", k % 7 + 1, "號")).alias("key_of_dashes"),
        G.clean_address(text("後甲國中(台南市東區東區林森路", section, "段", _chinese(k % 90 + 10), "號)")).alias("cleaned"),
        G.clean_address(F.when(k % 2 == 0, text("公民教室：三民區校本部建國路", k, "號2樓")).otherwise(text("教室", k, "號")), F.when(k % 2 == 0, "高雄市")).alias("cleaned_or_not"),
    )


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN '0.9' WHEN 'F' THEN '0.3' ELSE '0.5' END AS priority, CASE o_orderstatus WHEN 'O' THEN 'daily' WHEN 'F' THEN 'monthly' ELSE 'weekly' END AS changefreq, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS lastmod FROM orders
""")
def page_hints(spark, d):
    """Priority, change frequency and last change of pages."""
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("something else")
    hint, day = V.page_hint(status), F.date_format("o_orderdate", "yyyy-MM-dd")
    dates = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit(""), F.lit(None).cast("string"))).otherwise(F.array(F.lit(""), day, F.lit("1900-01-01")))
    return read(spark, d, "orders").select("o_orderkey", hint["priority"].alias("priority"), hint["changefreq"].alias("changefreq"), V.latest(dates).alias("lastmod"))
