"""Entity matching, dimension lookups and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as X
from ..operators import joins as J
from ..operators import resolve as R
from ..operators import windows as Wn
from .registry import read, registrar

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)


@query("""
WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY text) AS copies FROM documents)
SELECT doc_id, lang, n_chars FROM r WHERE k = 1
""")
def dedupe_first(spark, d):
    """The first document of each text."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("h"))
    return Wn.keep_first(docs, ["h"], [F.col("doc_id")]).select("doc_id", "lang", "n_chars")


@query("""
WITH e AS (SELECT min(doc_id) OVER (PARTITION BY text) AS a, doc_id AS b FROM documents)
SELECT b AS node, a AS component FROM e WHERE b IN (SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1)
""")
def components_relaxed(spark, d):
    """Components of documents with equal texts, by their links alone."""
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("a"))
    edges = docs.join(first, "h").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    return R.relaxed_components(edges)


def order_listings(spark, d):
    """Orders as listings: customers are schools, priorities titles, statuses teachers."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    return read(spark, d, "orders").select(
        F.lpad(k.cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"),
        F.concat(F.lit("臺北市"), F.col("o_custkey").cast("string"), F.when(k % 2 == 0, "社區大學").otherwise("社大")).alias("school"),
        F.concat(F.lit("【新】"), "o_orderpriority").alias("title"),
        F.when(k % 5 < 2, F.concat(F.lit("k"), F.quarter(day).cast("string"))).alias("code"),
        F.year(day).alias("term_year"),
        F.when(k % 4 != 0, F.lit("年")).alias("term_season"),
        F.when(k % 8 == 0, F.concat(F.year(day).cast("string"), F.lit(" 年"))).alias("term_raw"),
        F.col("o_orderstatus").alias("teacher"),
        F.when(k % 7 < 5, F.weekday(day) + 1).alias("weekday"),
        F.when(k % 7 < 3, F.lit("09:00")).alias("start"),
    )


@query()
def cluster_greedy(spark, d):
    """Greedy clusters with vetoes of all orders, as listings of their customers."""
    return R.cluster_greedy(order_listings(spark, d))


@query("""
WITH k AS (SELECT doc_id, 'text' AS rule, sha256(text) AS key FROM documents UNION ALL SELECT doc_id, 'head', lang || '|' || source || '|' || left(text, 40) FROM documents
  UNION ALL SELECT doc_id, 'size', lang || '|' || source || '|' || n_chars FROM documents)
SELECT rule, count(DISTINCT key) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS largest FROM (SELECT rule, key, count(*) AS n FROM k GROUP BY ALL HAVING count(*) > 1) GROUP BY rule
""")
def multi_key_match(spark, d):
    """Rows that meet under each of several blocking keys."""
    docs = read(spark, d, "documents")
    key = lambda rule, k: F.struct(F.lit(rule).alias("rule"), k.alias("key"))
    keys = F.array(key("text", F.sha2("text", 256)), key("head", F.concat_ws("|", "lang", "source", F.substring("text", 1, 40))), key("size", F.concat_ws("|", "lang", "source", F.col("n_chars").cast("string"))))
    met = docs.select(F.explode(keys).alias("k")).groupBy("k.rule", "k.key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return met.groupBy("rule").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"), F.max("n").alias("largest"))


@query("""
WITH s AS (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier WHERE s_acctbal > 5000 GROUP BY 1), w AS (SELECT s_nationkey, max(s_suppkey) AS k FROM supplier GROUP BY 1)
SELECT c.c_custkey, coalesce(s.k, w.k) AS supplier, CASE WHEN s.k IS NOT NULL THEN 'rich' WHEN w.k IS NOT NULL THEN 'any' ELSE 'none' END AS method
FROM customer c LEFT JOIN s ON c.c_nationkey = s.s_nationkey AND c.c_acctbal > 0 LEFT JOIN w ON c.c_nationkey = w.s_nationkey
""")
def priority_lookup(spark, d):
    """Each customer's supplier from the first lookup that matches."""
    c, s = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), read(spark, d, "supplier")
    rich = s.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n1")).agg(F.min("s_suppkey").alias("supplier"))
    any_ = s.groupBy(F.col("s_nationkey").alias("n2")).agg(F.max("s_suppkey").alias("supplier"))
    tries = [(rich, (F.col("c_nationkey") == F.col("n1")) & (F.col("c_acctbal") > 0), "rich"), (any_, F.col("c_nationkey") == F.col("n2"), "any")]
    return J.priority_lookup(c, "c_custkey", tries, ["supplier"]).select("c_custkey", "supplier", "method")


_TOKENS = [(1, "ST"), (2, "EST"), (3, "COPPER"), (4, "ANODIZED STEEL"), (5, "STEEL"), (6, "S"), (7, "TIN")]
_TOKEN_SQL = ", ".join(f"({a}, '{b}')" for a, b in _TOKENS)


def _tokens(spark):
    return spark.sql(f"SELECT * FROM VALUES {_TOKEN_SQL} AS t(ord, token)")


@query(f"""
WITH t(ord, token) AS (VALUES {_TOKEN_SQL}),
m AS (SELECT p_partkey, upper(p_type) AS ty, token, ord, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN upper(p_type) = token THEN 0 WHEN token IS NOT NULL THEN 1 ELSE 2 END, ord) AS k
  FROM part LEFT JOIN t ON ends_with(upper(p_type), token))
SELECT p_partkey, ty, ord FROM m WHERE k = 1
""")
def suffix_join(spark, d):
    """A dimension row whose name a text equals or ends with, as an equi-join."""
    p = read(spark, d, "part").select("p_partkey", F.upper("p_type").alias("ty"))
    return J.suffix_join(p, "p_partkey", "ty", _tokens(spark), "token", "ord", ["ord"])


@query(f"""
WITH t(ord, token) AS (VALUES {_TOKEN_SQL}),
m AS (SELECT p_partkey, token, row_number() OVER (PARTITION BY p_partkey ORDER BY length(token) DESC, ord) AS k FROM part JOIN t ON contains(upper(p_type), token))
SELECT p_partkey, token FROM m WHERE k = 1
""")
def longest_contains(spark, d):
    """The longest dimension word that a text contains."""
    return J.longest_contains(read(spark, d, "part"), "p_partkey", F.upper("p_type"), _tokens(spark), "token", "ord")


@query("""
WITH l AS (SELECT l_orderkey, l_returnflag AS f FROM lineitem), u AS (SELECT l_orderkey, min(f) AS b, max(f) AS b2 FROM l GROUP BY 1) SELECT l_orderkey, b AS l_returnflag FROM u WHERE b = b2
""")
def unique_lookup(spark, d):
    """Orders whose lines all lead to one return flag."""
    return J.unique_lookup(read(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag")


@query("""
SELECT o_orderkey, CASE WHEN c.c_custkey IS NULL THEN '' ELSE c.c_mktsegment END AS kind
FROM orders LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0) c ON o_custkey = c_custkey
""")
def detail_override(spark, d):
    """Details that replace the list's columns, blank where there are none."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("kind"))
    c = read(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("c"), F.col("c_mktsegment").alias("kind"))
    return J.override(o, c, "c").select("o_orderkey", "kind")


_POINTS = "SELECT s_suppkey, 22.0 + (s_suppkey * 37 % 300) / 100.0 AS lat, 120.0 + (s_suppkey * 53 % 200) / 100.0 AS lng FROM supplier"


def _points(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(k, (F.lit(22.0) + (k * 37 % 300) / 100.0).alias("lat"), (F.lit(120.0) + (k * 53 % 200) / 100.0).alias("lng"))


@query(f"""
SELECT s_suppkey, round(12742.0 * asin(sqrt(least(1.0, pow(sin((radians(25.04) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(25.04)) * pow(sin(radians(121.5 - lng) / 2), 2)))), 6) AS km
FROM ({_POINTS}) ORDER BY km, s_suppkey LIMIT 20
""")
def haversine_near(spark, d):
    """The twenty places nearest to a point."""
    km = F.round(geo.haversine_km(F.col("lat"), F.col("lng"), F.lit(25.04), F.lit(121.5)), 6)
    return _points(spark, d).select("s_suppkey", km.alias("km")).orderBy("km", "s_suppkey").limit(20)


@query("""
WITH p AS (SELECT s_suppkey, 180000.0 + (s_suppkey * 4241 % 140000) AS x, 2450000.0 + (s_suppkey * 7919 % 300000) AS y FROM supplier),
c AS (SELECT *, 6378137.0 AS a, (1/298.257222101) * (2 - 1/298.257222101) AS e2 FROM p),
c2 AS (SELECT *, e2 / (1 - e2) AS ep2, (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2)) AS e1 FROM c),
m AS (SELECT *, y / 0.9999 / (a * (1 - e2/4 - 3*pow(e2,2)/64 - 5*pow(e2,3)/256)) AS mu FROM c2),
f AS (SELECT *, mu + (3*e1/2 - 27*pow(e1,3)/32)*sin(2*mu) + (21*pow(e1,2)/16 - 55*pow(e1,4)/32)*sin(4*mu) + (151*pow(e1,3)/96)*sin(6*mu) + (1097*pow(e1,4)/512)*sin(8*mu) AS fp FROM m),
g AS (SELECT *, ep2*pow(cos(fp),2) AS c1, pow(tan(fp),2) AS t1, a/sqrt(1 - e2*pow(sin(fp),2)) AS n1, a*(1-e2)/pow(1 - e2*pow(sin(fp),2), 1.5) AS r1 FROM f),
h AS (SELECT *, (x - 250000.0)/(n1*0.9999) AS dd FROM g)
SELECT s_suppkey, round(degrees(fp - (n1*tan(fp)/r1)*(pow(dd,2)/2 - (5+3*t1+10*c1-4*pow(c1,2)-9*ep2)*pow(dd,4)/24 + (61+90*t1+298*c1+45*pow(t1,2)-252*ep2-3*pow(c1,2))*pow(dd,6)/720)), 6) AS lat,
 round(121.0 + degrees((dd - (1+2*t1+c1)*pow(dd,3)/6 + (5-2*c1+28*t1-3*pow(c1,2)+8*ep2+24*pow(t1,2))*pow(dd,5)/120)/cos(fp)), 6) AS lng FROM h
""")
def tm2_inverse(spark, d):
    """Grid metres to latitude and longitude."""
    k = F.col("s_suppkey")
    p = read(spark, d, "supplier").select(k, (F.lit(180000.0) + (k * 4241 % 140000)).alias("x"), (F.lit(2450000.0) + (k * 7919 % 300000)).alias("y"))
    got = geo.resolve_coords(F.col("x"), F.col("y"))
    return p.select(k, F.round(got["lat"], 6).alias("lat"), F.round(got["lng"], 6).alias("lng"))


_COUNTY = "list_extract([" + ", ".join(f"'{c}'" for c in X.COUNTIES) + "], CAST({0} % 22 AS INTEGER) + 1)"
_BARE = "regexp_replace(nk, '^(" + "|".join(X.COUNTIES) + ")', '')"


@query(f"""
WITH r AS (SELECT 'ven' || lpad(s_suppkey::VARCHAR, 9, '0') AS id, 'a' || (s_suppkey % 40) AS ak, {_COUNTY.format("s_nationkey")} AS city, (CASE WHEN s_suppkey % 2 = 0 THEN {_COUNTY.format("s_nationkey")} ELSE '' END) || 'n' || (s_suppkey % 90) AS nk, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS lat FROM supplier),
c AS (SELECT c_custkey, 'a' || (c_custkey % 70) AS ak, {_COUNTY.format("c_nationkey")} AS city, (CASE WHEN c_custkey % 3 = 0 THEN {_COUNTY.format("c_nationkey")} ELSE '' END) || 'n' || (c_custkey % 130) AS nk FROM customer),
g AS (SELECT 'a' || (n_nationkey * 3) AS ak, 23.0 + n_nationkey / 100.0 AS lat FROM nation),
ra AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ak ORDER BY CASE WHEN lat <> 0 THEN 0 ELSE 1 END, id) AS k FROM r) WHERE k = 1),
rn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN lat <> 0 THEN 0 ELSE 1 END, id) AS k FROM (SELECT *, unnest(list_distinct([nk, {_BARE}])) AS key FROM r)) WHERE k = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY prio) AS k FROM (
  SELECT c_custkey, c.city AS c_city, 1 AS prio, rn.* EXCLUDE (k) FROM c JOIN rn ON c.nk = rn.key UNION ALL SELECT c_custkey, c.city, 2, rn.* EXCLUDE (k) FROM c JOIN rn ON regexp_replace(c.nk, '^({"|".join(X.COUNTIES)})', '') = rn.key)) WHERE k = 1 AND c_city = city),
h AS (SELECT c_custkey, 0 AS prio, 'registry-address' AS m, ra.id, ra.ak, ra.lat FROM c JOIN ra ON c.ak = ra.ak UNION ALL SELECT c_custkey, 1, 'registry-name', id, ak, lat FROM n),
b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY rank, prio) AS k FROM (SELECT h.*, CASE WHEN h.lat <> 0 THEN 0 WHEN prio = 0 THEN 1 WHEN g.ak IS NOT NULL THEN 9 ELSE 2 END AS rank FROM h JOIN c USING (c_custkey) LEFT JOIN g ON g.ak = c.ak) WHERE rank < 9)
SELECT c.c_custkey AS cluster, coalesce(b.id, 'ven_' || left(sha256(c.ak), 8)) AS venue_id, coalesce(b.m, CASE WHEN g.ak IS NOT NULL THEN 'geocoded-address' ELSE 'derived-address' END) AS method,
  (CASE WHEN b.id IS NOT NULL THEN CASE WHEN b.lat <> 0 OR o.ak IS NOT NULL THEN 0.95 ELSE 0.8 END WHEN g.ak IS NOT NULL THEN 0.95 ELSE 0.6 END)::DOUBLE AS confidence,
  round(CASE WHEN b.id IS NOT NULL THEN CASE WHEN b.lat <> 0 THEN b.lat ELSE o.lat END ELSE g.lat END::DOUBLE, 6) AS lat
FROM c LEFT JOIN b ON c.c_custkey = b.c_custkey AND b.k = 1 LEFT JOIN g ON g.ak = c.ak LEFT JOIN g o ON o.ak = b.ak
""")
def venue_resolution(spark, d):
    """Courses to venues by address, then name within the county, then geocoded or derived."""
    s, c, n = read(spark, d, "supplier"), read(spark, d, "customer"), read(spark, d, "nation")
    key = lambda p, col, m: F.concat(F.lit(p), (F.col(col) % m).cast("string"))
    county = lambda col: F.get(F.array(*[F.lit(x) for x in X.COUNTIES]), F.col(col) % 22)
    named = lambda nation, col, every, m: F.concat(F.when(F.col(col) % every == 0, county(nation)).otherwise(F.lit("")), key("n", col, m))
    reg = s.select(F.concat(F.lit("ven"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("venue_id"), county("s_nationkey").alias("city"), key("a", "s_suppkey", 40).alias("address_key"), named("s_nationkey", "s_suppkey", 2, 90).alias("name_key"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("lat"), F.lit(120.0).alias("lng"))
    courses = c.select(F.col("c_custkey").alias("cluster"), county("c_nationkey").alias("city"), key("a", "c_custkey", 70).alias("address_key"), named("c_nationkey", "c_custkey", 3, 130).alias("venue_key"), F.lit("").alias("provider_key"))
    geocodes = n.select(F.concat(F.lit("a"), (F.col("n_nationkey") * 3).cast("string")).alias("address_key"), (F.lit(23.0) + F.col("n_nationkey") / 100.0).alias("lat"), F.lit(121.0).alias("lng"))
    return R.resolve_venues(courses, reg, geocodes).select("cluster", "venue_id", "method", "confidence", F.round("lat", 6).alias("lat"))


@query("""
WITH m AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS pri, (o_orderkey % 4) / 4.0 AS conf FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY conf DESC, o_orderstatus, o_orderkey) AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY pri IS NULL, conf DESC, o_orderstatus, o_orderkey) AS kp FROM m),
b AS (SELECT o_custkey, max(o_orderstatus) FILTER (k = 1) AS st, max(pri) FILTER (kp = 1) AS pri, count(*) AS n_sources, max(o_orderkey) FILTER (k = 1) AS first_record FROM r GROUP BY 1),
l AS (SELECT m.o_custkey, count(DISTINCT m.o_orderstatus) FILTER (m.o_orderstatus <> b.st) AS ls FROM m JOIN b USING (o_custkey) GROUP BY 1)
SELECT b.o_custkey, st AS o_orderstatus, pri, n_sources, first_record, ls AS n_lost FROM b JOIN l USING (o_custkey)
""")
def projection(spark, d):
    """One row per entity: best values, sources in order of preference, values that lost."""
    from ..operators.project import project

    o = read(spark, d, "orders")
    m = o.select("o_custkey", "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("pri"), ((F.col("o_orderkey") % 4) / 4.0).alias("conf"))
    m = m.withColumn("src", F.lit("orders"))
    out = project(m, "o_custkey", ["o_orderstatus", "pri"], "src", "o_orderkey", "conf", "o_orderstatus")
    lost = F.size(F.filter("rejected", lambda x: x["field"] == "o_orderstatus")).cast("long")
    return out.select("o_custkey", "o_orderstatus", "pri", F.size("sources").cast("long").alias("n_sources"), F.get("sources", F.lit(0))["record"].alias("first_record"), lost.alias("n_lost"))
