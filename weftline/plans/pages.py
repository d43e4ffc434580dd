"""Topics, college hubs and page checks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import COUNTIES
from ..operators import pages as P
from .registry import read, registrar

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)

_SEGMENTS = ("MACHINERY", "BUILDING", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE")
_COUNTY = "list_extract([" + ", ".join(f"'{c}'" for c in COUNTIES) + "], CAST(c_nationkey % 22 AS INTEGER) + 1)"


@query(f"""
SELECT c_mktsegment AS name, list_position([{", ".join(f"'{s}'" for s in _SEGMENTS)}], c_mktsegment) AS ord, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderkey % 3 = 0) AS n_inferred
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def topics(spark, d):
    """Listings by topic in the given order, with how many were classified by their titles."""
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    known = spark.createDataFrame([(s, k + 1) for k, s in enumerate(_SEGMENTS)], "name string, k int")
    return P.topics(o.join(c, o.o_custkey == c.c_custkey), "c_mktsegment", known, "name", "k", F.col("o_orderstatus") == "O", F.col("o_orderkey") % 3 == 0)


@query(f"""
WITH m AS (SELECT CASE c_custkey % 3 WHEN 0 THEN '臺北市Q' || (c_custkey % 40) || '社大' WHEN 1 THEN 'Q' || (c_custkey % 40) || '社大' ELSE 'Q' || (c_custkey % 40) || '社區大學' END AS raw, 'Q' || (c_custkey % 40) || '社區大學' AS name,
  c_custkey % 3 AS kind, CASE WHEN c_custkey % 3 = 1 THEN {_COUNTY} END AS city, (c_acctbal > 0)::INT AS c, (c_mktsegment = 'BUILDING')::INT AS o FROM customer),
k AS (SELECT raw, city, count(*) AS k FROM m WHERE city IS NOT NULL GROUP BY ALL), u AS (SELECT raw, city AS usual FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY k DESC, city DESC) AS nth FROM k) WHERE nth = 1),
r AS (SELECT m.raw, name, CASE WHEN kind = 0 THEN '臺北市' ELSE usual END AS place, count(*) AS n, sum(c) AS c, sum(o) AS o FROM m LEFT JOIN u ON u.raw = m.raw GROUP BY ALL),
s AS (SELECT name, min(place) AS place FROM r WHERE place IS NOT NULL GROUP BY 1 HAVING count(DISTINCT place) = 1),
f AS (SELECT name, place, n, c, o FROM r WHERE place IS NOT NULL UNION ALL SELECT r.name, s.place, n, c, o FROM r JOIN s ON s.name = r.name WHERE r.place IS NULL),
h AS (SELECT name, place, sum(n)::BIGINT AS n, sum(c)::BIGINT AS n_current, sum(o)::BIGINT AS n_open FROM f GROUP BY 1, 2)
SELECT CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN place || name ELSE name END AS name, place AS city, n, n_current, n_open FROM h
""")
def college_hubs(spark, d):
    """Colleges under one name however they are written, each with its city."""
    k = F.col("c_custkey")
    no = (k % 40).cast("string")
    raw = F.when(k % 3 == 0, F.concat(F.lit("臺北市Q"), no, F.lit("社大"))).when(k % 3 == 1, F.concat(F.lit("Q"), no, F.lit("社大"))).otherwise(F.concat(F.lit("Q"), no, F.lit("社區大學")))
    city = F.when(k % 3 == 1, F.get(F.array(*[F.lit(c) for c in COUNTIES]), (F.col("c_nationkey") % 22).cast("int")))
    return P.college_hubs(read(spark, d, "customer").withColumns({"raw": raw, "city": city}), "raw", "city", F.col("c_acctbal") > 0, F.col("c_mktsegment") == "BUILDING")


@query("""
WITH e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'https://y.tw/o/' || o_orderkey ELSE 'https://x.tw/o/' || o_orderkey || CASE WHEN o_orderkey % 29 = 0 THEN ' 臺' ELSE '' END END AS loc FROM orders WHERE o_orderkey % 11 <> 0)
SELECT loc, 'not of this site' AS problem FROM e WHERE k % 13 = 0
UNION ALL SELECT loc, 'wrong encoding' FROM e WHERE k % 13 <> 0 AND k % 29 = 0
UNION ALL SELECT loc, 'no such page' FROM e WHERE k % 13 <> 0 AND (k % 29 = 0 OR k % 7 = 0)
UNION ALL SELECT loc, 'not to be indexed' FROM e WHERE k % 13 <> 0 AND k % 29 <> 0 AND k % 7 <> 0 AND k % 5 = 0
UNION ALL SELECT loc, 'date' FROM e WHERE k % 17 = 0 UNION ALL SELECT loc, 'frequency' FROM e WHERE k % 19 = 0 UNION ALL SELECT loc, 'priority' FROM e WHERE k % 23 = 0
UNION ALL SELECT 'o/' || o_orderkey, 'page not listed' FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 29 = 0)
""")
def sitemap_problems(spark, d):
    """What is wrong with a sitemap, entry by entry, and which pages it leaves out."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    name = F.col("k").cast("string")
    loc = F.when(F.col("k") % 13 == 0, F.concat(F.lit("https://y.tw/o/"), name)).otherwise(F.concat(F.lit("https://x.tw/o/"), name, F.when(F.col("k") % 29 == 0, " 臺").otherwise("")))
    told = lambda every, bad, good: F.when(F.col("k") % every == 0, bad).otherwise(good)
    entries = o.where("k % 11 <> 0").select(F.floor(F.col("k") / 1000).alias("file"), loc.alias("loc"), told(17, "x", "2026-01-01").alias("lastmod"), told(19, "often", "daily").alias("changefreq"), told(23, "2", "0.5").alias("priority"))
    pages = o.where("k % 7 <> 0").select(F.concat(F.lit("o/"), name).alias("path"), (F.col("k") % 5 != 0).alias("indexed"))
    return P.sitemap_problems(entries, pages, "https://x.tw")


@query("""
WITH c AS (SELECT c_mktsegment || (c_custkey % 12) AS college, c_nationkey * 100 + c_custkey % 12 * (c_custkey % 5 > 0)::INTEGER AS venue, c_acctbal > 4000 AS now FROM customer),
k AS (SELECT college, venue, count(*) AS n, count(*) FILTER (now) AS n_now FROM c GROUP BY 1, 2), s AS (SELECT venue, count(*) AS size FROM c GROUP BY 1),
t AS (SELECT *, max(n_now) OVER (PARTITION BY college) AS top_now, max(n) OVER (PARTITION BY college) AS top FROM k),
b AS (SELECT college, min(venue) AS venue FROM t WHERE CASE WHEN top_now > 0 THEN n_now = top_now ELSE n = top END GROUP BY 1)
SELECT b.college, b.venue, k.n, round(k.n / s.size, 6) AS share FROM b JOIN k ON k.college = b.college AND k.venue = b.venue JOIN s ON s.venue = b.venue WHERE k.n / s.size >= 0.2 AND b.venue % 3 <> 0
""")
def main_venues(spark, d):
    """The venue where a college teaches most, if it has enough of what the venue shows."""
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(F.concat("c_mktsegment", (k % 12).cast("string")).alias("college"), (F.col("c_nationkey") * 100 + F.when(k % 5 > 0, k % 12).otherwise(0)).alias("venue"), (F.col("c_acctbal") > 4000).alias("now"))
    found = P.main_venues(rows, "college", "venue", F.col("now"), rows.where("venue % 3 <> 0").select("venue"), share=0.2)
    return found.withColumn("share", F.round("share", 6))


@query("""
WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k, 'price is no number' AS problem FROM o WHERE k % 3 = 0 OR k % 7 = 0 UNION ALL SELECT k, 'price without currency' FROM o WHERE k % 5 = 0
UNION ALL SELECT k, 'availability' FROM o WHERE k % 11 = 0 UNION ALL SELECT k, 'provider without a name' FROM o WHERE k % 13 = 0 UNION ALL SELECT k, 'coordinates' FROM o WHERE k % 17 = 0
""")
def document_checks(spark, d):
    """Problems of course documents: prices written as text, offers of the instance, coordinates."""
    k = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    price = F.when(k % 3 == 0, '"100"').otherwise((k % 90).cast("string"))
    offer = text('{"price":', price, F.when(k % 5 == 0, "").otherwise(',"priceCurrency":"TWD"'), ',"availability":"https://schema.org/InStock"}')
    inner = text('{"price":', F.when(k % 7 == 0, '"free"').otherwise("1.5"), ',"priceCurrency":"TWD","availability":"', F.when(k % 11 == 0, "soon").otherwise("https://schema.org/InStock"), '"}')
    where = text('{"geo":{"latitude":', F.when(k % 17 == 0, "2").otherwise("24.5"), ',"longitude":121}}')
    json = text('{"provider":{"name":"', F.when(k % 13 == 0, "").otherwise("x"), '"},"offers":', offer, ',"hasCourseInstance":{"offers":', inner, ',"location":', where, "}}")
    return P.course_ld_problems(read(spark, d, "orders").select(k.alias("k"), json.alias("json")), "k", "json")
