"""Parts of reports, rule tables and page dates over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import page_dates as D
from ..operators import reports as R
from ..operators.rule_table import label_texts
from .registry import read, registrar

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)


@query("""
SELECT c_custkey AS id, o.k AS ord FROM customer JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON regexp_matches(c_name, '(?i)cust[a-z]+#0*' || o.k || '$')
UNION ALL SELECT c_custkey, -1 FROM customer WHERE regexp_matches(c_name, '[0-9]7$') UNION ALL SELECT c_custkey, -2 FROM customer WHERE regexp_matches(c_name, '1(1|2)3')
""")
def rule_table(spark, d):
    """A rule for every customer that has orders, filed under its rarest literal; two rules more."""
    key = F.col("o_custkey")
    rules = read(spark, d, "orders").select(key).distinct().select(key.alias("ord"), F.concat(F.lit("CUST[a-z]+#0*"), key.cast("string"), F.lit("$")).alias("pattern"))
    more = spark.sql("SELECT * FROM VALUES (-1L, '[0-9]7$'), (-2L, '1(1|2)3') AS t(ord, pattern)")
    return label_texts(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text")), rules.unionByName(more))


_PAGES = "old AS (SELECT o_custkey AS page, o_orderkey AS item, o_orderstatus AS h FROM orders WHERE o_orderkey % 50 <> 1), new AS (SELECT o_custkey AS page, o_orderkey AS item, CASE WHEN o_orderkey % 40 = 3 THEN 'X' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 60 <> 7)"


@query(f"""
WITH {_PAGES},
c AS (SELECT DISTINCT coalesce(new.page, old.page) AS page FROM new FULL JOIN old ON new.page = old.page AND new.item = old.item WHERE new.item IS NULL OR old.item IS NULL OR new.h <> old.h)
SELECT p.page, CASE WHEN c.page IS NOT NULL OR o.page IS NULL THEN '2026-02-02' ELSE '2026-01-01' END AS lastmod, CASE WHEN c.page IS NOT NULL OR o.page IS NULL THEN '2026-02-02' ELSE '2026-01-01' END AS lastmod_full
FROM (SELECT DISTINCT page FROM new) p LEFT JOIN c ON c.page = p.page LEFT JOIN (SELECT DISTINCT page FROM old) o ON o.page = p.page
""")
def page_dates(spark, d):
    """When pages last changed, by the changes on them and by comparing whole lists."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("hash"))
    old, new = o.where("item % 50 <> 1"), o.where("item % 60 <> 7").withColumn("hash", F.when(F.col("item") % 40 == 3, "X").otherwise(F.col("hash")))
    dates, today = old.select("page").distinct().withColumn("lastmod", F.lit("2026-01-01")), F.lit("2026-02-02")
    by_change = D.apply_changes(dates, new, D.member_changes(old, new), today)
    return by_change.join(D.full_dates(old, new, dates, today).withColumnRenamed("lastmod", "lastmod_full"), "page")


@query("""
SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_mktsegment IS NULL OR 'at/' || c_nationkey || '/' || (c_custkey % 7) IN (SELECT 'at/' || s_nationkey || '/' || (s_suppkey % 7) FROM supplier WHERE s_acctbal > 3000)
""")
def paused_pages(spark, d):
    """Pages of a paused kind stay only where they are listed."""
    path = lambda a, b: F.concat(F.lit("at/"), F.col(a).cast("string"), F.lit("/"), (F.col(b) % 7).cast("string"))
    listed = read(spark, d, "supplier").where("s_acctbal > 3000").select(path("s_nationkey", "s_suppkey").alias("path"))
    return R.whitelisted(read(spark, d, "customer"), path("c_nationkey", "c_custkey"), listed, F.col("c_mktsegment") == "BUILDING").select("c_custkey")


@query("""
WITH t AS (SELECT o_custkey AS k, o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '瑜珈' WHEN 1 THEN '空中瑜珈' WHEN 2 THEN '新手的空中瑜珈班' WHEN 3 THEN '熱瑜珈' ELSE '空中瑜珈' END AS title FROM orders),
p AS (SELECT k, id, nullif(regexp_extract(title, '([一-鿿A-Za-z0-9]{1,4})瑜珈', 1), '') AS prefix FROM t),
c AS (SELECT k, prefix, count(*) AS n, min(id) AS first FROM p GROUP BY 1, 2), s AS (SELECT k, sum(n)::BIGINT AS total FROM c GROUP BY 1),
b AS (SELECT * FROM c WHERE prefix IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, first) = 1)
SELECT b.k, prefix, n, total FROM b JOIN s USING (k) WHERE n > total * 0.5
""")
def dominant_prefix(spark, d):
    """What more than half of a customer's titles put before the activity's name."""
    n = F.col("o_orderkey") % 5
    title = F.when(n == 0, "瑜珈").when(n == 2, "新手的空中瑜珈班").when(n == 3, "熱瑜珈").otherwise("空中瑜珈")
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), title.alias("title"), F.lit("瑜珈").alias("word"))
    return R.dominant_prefix(rows, ["k"], "title", "word", "id")


@query("""
WITH c AS (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), s AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS acts FROM orders GROUP BY 1)
SELECT o.o_orderkey, coalesce(list_has_any(s.acts, ['1-URGENT', '5-LOW']), false)::INTEGER AS shares FROM orders o LEFT JOIN s ON s.o_custkey = o.o_custkey WHERE o.o_orderkey NOT IN (SELECT l_orderkey FROM c)
""")
def other_listings(spark, d):
    """Listings that are not among the current ones, and whether their provider shares an activity."""
    o = read(spark, d, "orders")
    left = R.others(o.withColumnRenamed("o_orderkey", "l_orderkey"), read(spark, d, "lineitem").where("l_returnflag = 'R'"), "l_orderkey")
    acts = o.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("acts"))
    shares = R.shares_any(F.col("acts"), F.array(F.lit("1-URGENT"), F.lit("5-LOW")))
    return left.join(acts, "o_custkey", "left").select(F.col("l_orderkey").alias("o_orderkey"), shares.cast("int").alias("shares"))


@query(r"""
WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z]+)', 1))) AS kind FROM pages) SELECT kind, count(*) AS n, count(DISTINCT page_id) AS pages FROM t GROUP BY 1
""")
def type_counts(spark, d):
    """Kinds of elements by occurrences and by pages."""
    return R.type_counts(read(spark, d, "pages"), "page_id", F.regexp_extract_all(F.lower("html"), F.lit("<([a-z]+)"), F.lit(1)))


@query("""
WITH v AS (SELECT c_nationkey AS venue, count(*) FILTER (c_acctbal > 0) AS n_current, count(*) AS n FROM customer GROUP BY 1)
SELECT venue, n_current, n, row_number() OVER (ORDER BY n_current DESC, n DESC, venue) AS place FROM v
""")
def venues_by_usage(spark, d):
    """Venues in use first; their place in the list."""
    from ..operators.windows import row_numbers

    v = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("venue")).agg(F.count_if(F.col("c_acctbal") > 0).alias("n_current"), F.count(F.lit(1)).alias("n"))
    return row_numbers(v, R.by_usage("n_current", "n", "venue"), "place")


@query("""
SELECT CASE WHEN o_custkey % 5 = 0 THEN '未標示縣市' ELSE 'c' || (o_custkey % 5) END AS city, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1
""")
def open_by_city(spark, d):
    """Open listings by county, with a bucket for those without one."""
    city = F.when(F.col("o_custkey") % 10 == 0, "").when(F.col("o_custkey") % 5 != 0, F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string")))
    return R.open_by_city(read(spark, d, "orders").withColumn("city", city), "city", F.col("o_orderstatus") == "O")


@query("""
SELECT l_suppkey, CAST(sum(CASE WHEN l_linenumber % 3 > 0 THEN l_quantity::BIGINT END) AS BIGINT) AS seats, count(*) FILTER (l_returnflag = 'R') AS n_full, count(*) FILTER (l_linenumber % 3 > 0) AS n_known, strftime(max(l_shipdate), '%Y-%m-%d') AS verified FROM lineitem GROUP BY 1
""")
def seat_sums(spark, d):
    """Free seats, full listings and the last look by venue."""
    l = read(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity").cast("long")).alias("a"), F.when(F.col("l_returnflag") == "R", "full").otherwise("open").alias("s"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("v"))
    return R.seat_sums(l, ["l_suppkey"], "a", "s", "v")


@query("""
WITH h AS (SELECT c_nationkey, c_mktsegment, count(*) FILTER (c_acctbal > 9000) AS n FROM customer GROUP BY 1, 2)
SELECT c_nationkey, string_agg(c_mktsegment || '=' || n, ';' ORDER BY length(c_mktsegment), c_mktsegment) AS links FROM h WHERE n > 0 GROUP BY 1
""")
def hub_links(spark, d):
    """The special pages that each city has, with their counts."""
    h = read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count_if(F.col("c_acctbal") > 9000).alias("n"), F.max(F.length("c_mktsegment")).alias("o"))
    got = R.hub_links(h, "c_nationkey", "c_mktsegment", "o", F.col("c_mktsegment"), F.concat(F.lit("/"), "c_mktsegment"), "n")
    return got.select("c_nationkey", F.array_join(F.transform("links", lambda x: F.concat(x["text"], F.lit("="), x["n"].cast("string"))), ";").alias("links"))


@query("""
WITH s AS (SELECT s_suppkey AS k, '臺北市中山路' || (s_suppkey % 30) || '號' AS key FROM supplier),
g AS (SELECT key, arg_max(24 + (k % 8) / 8.0, k) AS lat, arg_max(121.25, k) AS lng FROM s WHERE k % 4 <> 1 GROUP BY 1)
SELECT key, lat::DOUBLE AS lat, lng::DOUBLE AS lng, NULL::BIGINT AS n FROM g
UNION ALL SELECT a.key, NULL, NULL, count(*) FROM (SELECT '臺北市中山路' || (c_custkey % 45) || '號' AS key FROM customer) a WHERE a.key NOT IN (SELECT key FROM g) GROUP BY 1
""")
def geocode_files(spark, d):
    """Known coordinates out of a landed file, and the addresses it does not resolve with their listings."""
    k = F.col("s_suppkey")
    where = F.concat(F.lit("﻿台北市中山路"), (k % 30).cast("string"), F.lit("號3樓"))
    line = F.concat(where, F.lit(","), F.when(k % 4 == 1, "x").otherwise((F.lit(24) + (k % 8) / F.lit(8.0)).cast("string")), F.lit(",121.25,matched"))
    known = R.geocode_lookup(read(spark, d, "supplier").select(k.alias("at"), line.alias("line")), "line", "at")
    asked = read(spark, d, "customer").select(F.concat(F.lit("臺北市中山路"), (F.col("c_custkey") % 45).cast("string"), F.lit("號")).alias("key"))
    none = F.lit(None)
    return known.withColumn("n", none.cast("long")).unionByName(R.unresolved(asked, "key", known).select("key", none.cast("double").alias("lat"), none.cast("double").alias("lng"), "n"))


@query("""SELECT c_custkey::VARCHAR AS key, '{"balance":' || (c_acctbal > 0) || ',"name":"' || c_name || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"segment":"' || c_mktsegment || '"' ELSE '' END || '}' AS value FROM customer""")
def state_documents(spark, d):
    """State rows as JSON whose fields are in the order of their names."""
    c = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"), (F.col("c_acctbal") > 0).alias("balance"))
    return R.state_document(c, "c_custkey", ["segment", "name", "balance"])
