"""Faceted, ranked and "what next" reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import windows as Wn
from ..operators.files import file_numbers
from ..operators.scan import running
from .registry import read, registrar

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)


def _orders_by_place(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    places = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return o.join(c, o.o_custkey == c.c_custkey).join(places, F.col("c_nationkey") == F.col("n_nationkey"))


@query("""
WITH j AS (SELECT r_name, n_name, c_mktsegment, o_orderstatus = 'O' AS opn FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT r_name, n_name, c_mktsegment, count(*) AS n, sum(opn::INT)::BIGINT AS n_open, CASE grouping(r_name, n_name, c_mktsegment) WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS level
  FROM j GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (r_name, n_name, c_mktsegment)))
SELECT r_name, n_name, c_mktsegment, n, n_open, level FROM g WHERE n >= CASE level WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 8 END
""")
def facet_rollup(spark, d):
    """Counts by area, city and kind with a threshold at each level, in one shuffle."""
    j = _orders_by_place(spark, d)
    return A.facet_rollup(j, ["r_name", "n_name", "c_mktsegment"], [20, 10, 8], F.col("o_orderstatus") == "O").select("r_name", "n_name", "c_mktsegment", "n", "n_open", "level")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) AS k FROM c)
SELECT user_id, event_type AS main_type, n AS main_type_n FROM r WHERE k = 1
""")
def mode_tie(spark, d):
    """Each user's most frequent event type; ties to the larger label."""
    return A.mode_tie(read(spark, d, "events"), ["user_id"], "event_type", "main_type")


@query("""
WITH b AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS p, l_discount = 0 AS fr, l_shipdate >= TIMESTAMP '1995-01-01' AS cur FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) FILTER (cur) AS n_current, count(*) FILTER (cur AND fr) AS n_free, count(*) FILTER (cur AND NOT fr AND p IS NOT NULL) AS n_priced,
  count(*) FILTER (cur) - count(*) FILTER (cur AND fr) - count(*) FILTER (cur AND NOT fr AND p IS NOT NULL) AS n_unpriced,
  min(p) FILTER (cur AND NOT fr) AS min_price, max(p) FILTER (cur AND NOT fr) AS max_price, CAST(floor(median(p) FILTER (cur AND NOT fr) + 0.5) AS BIGINT) AS median_price
FROM b GROUP BY ALL
""")
def facts_summary(spark, d):
    """Free, priced and unpriced rows with least, median and most price."""
    l = read(spark, d, "lineitem")
    return A.price_facts(l, ["l_returnflag", "l_linestatus"], "l_extendedprice", F.col("l_discount") == 0, F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))


@query("""
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY c_nationkey) AS BIGINT) AS total FROM c)
SELECT c_nationkey, c_mktsegment, n, total FROM t WHERE n >= total * 0.25
""")
def dominant_share(spark, d):
    """Kinds that make up at least a quarter of their city."""
    return A.dominant(read(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", 0.25)


@query("""
WITH o AS (SELECT *, o_orderdate < TIMESTAMP '1997-01-01' AS ended, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'running' ELSE 'closed' END AS st, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
r AS (SELECT o_custkey, o_orderkey, st AS status, day, row_number() OVER (PARTITION BY o_custkey ORDER BY ended, CASE st WHEN 'open' THEN 0 WHEN 'running' THEN 2 ELSE 5 END, day DESC, o_orderkey) AS rank FROM o)
SELECT o_custkey, o_orderkey, status, day, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
""")
def status_sort_topk(spark, d):
    """Each customer's first three orders: not ended, by status, newest first."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "running").otherwise("closed")
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", status.alias("status"), day.alias("day"))
    order = [*Wn.by_status_then_date(F.col("day") < "1997-01-01", F.col("status"), F.col("day")), F.col("o_orderkey")]
    return Wn.top_k(o, ["o_custkey"], order, 3, "rank")


@query("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_totalprice ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM f WHERE k = 1)
SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM p WHERE r <= 2 ORDER BY o_orderdate, o_orderkey LIMIT 100
""")
def provider_cap(spark, d):
    """The soonest 100 orders, at most two a customer, duplicates left out first."""
    o = read(spark, d, "orders")
    picked = Wn.capped_pick(o, ["o_custkey", "o_totalprice"], ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 2, 100)
    return picked.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""
WITH o AS (SELECT o_orderkey, lead(o_orderkey, 1) OVER w AS n1, lead(o_orderdate, 1) OVER w AS d1, lead(o_orderkey, 2) OVER w AS n2, lead(o_orderdate, 2) OVER w AS d2,
  lead(o_orderkey, 3) OVER w AS n3, lead(o_orderdate, 3) OVER w AS d3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
u AS (SELECT o_orderkey, n1 AS next_id, d1 AS next_at, 1 AS rank FROM o UNION ALL SELECT o_orderkey, n2, d2, 2 FROM o UNION ALL SELECT o_orderkey, n3, d3, 3 FROM o)
SELECT o_orderkey, next_id, strftime(next_at, '%Y-%m-%d') AS next_day, rank FROM u WHERE next_id IS NOT NULL
""")
def successors(spark, d):
    """The next three orders of the same customer."""
    s = J.successors(read(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderdate", 3)
    return s.select("o_orderkey", "next_id", F.date_format("next_at", "yyyy-MM-dd").alias("next_day"), "rank")


@query("""
WITH t AS (SELECT a.p_partkey, b.p_partkey AS other, CASE WHEN a.p_brand = b.p_brand AND a.p_size = b.p_size THEN 0 WHEN a.p_brand = b.p_brand THEN 1 ELSE 2 END AS tier, b.p_retailprice AS price
  FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND (a.p_brand = b.p_brand OR a.p_type = b.p_type)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, price, other) AS rank FROM t)
SELECT p_partkey, other, tier, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6
""")
def tiered_fill(spark, d):
    """Six alternatives a part: same brand and size, then same brand, then same type."""
    p = read(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", F.col("p_retailprice").alias("price"))
    return J.tiered_fill(p, "p_partkey", [["p_brand", "p_size"], ["p_brand"], ["p_type"]], ["price", "p_partkey"], 6)


@query("""SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) > 1 AS collides FROM part""")
def collision_flag(spark, d):
    """Whether another part has the same name."""
    return Wn.collision_flag(read(spark, d, "part").select("p_partkey", "p_name"), ["p_name"], "collides")


@query("""
SELECT p_brand, arg_min(p_name, p_partkey) AS p_name, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS p_type_set, max(p_size) AS max_p_size FROM part GROUP BY p_brand
""")
def collapse_set(spark, d):
    """One row a brand: the first name, sorted distinct types, largest size."""
    return A.collapse(read(spark, d, "part"), ["p_brand"], "p_partkey", ["p_name"], ["p_type"], ["p_size"])


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey, o_orderstatus FROM r WHERE k = 1
""")
def argmax_latest(spark, d):
    """Each customer's latest order; of the same day the smallest key."""
    o = read(spark, d, "orders")
    out = A.latest(o, ["o_custkey"], "o_orderdate", "o_orderkey", ["o_orderkey", "o_orderstatus"])
    return out.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", "o_orderstatus")


@query("""
WITH r AS (SELECT o_orderkey, CAST(ceil(row_number() OVER (ORDER BY o_orderkey) / 2000.0) AS BIGINT) AS chunk, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
SELECT chunk, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, max(day) AS lastmod FROM r GROUP BY chunk
""")
def chunk_index(spark, d):
    """Files of 2,000 rows in key order, with their last date; numbered without one big sort."""
    o = read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    c = Wn.chunk_ids(o, [F.col("o_orderkey")], 2000, "chunk")
    return c.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.max("day").alias("lastmod"))


@query("""
WITH RECURSIVE c AS (SELECT c_custkey AS k, length(c_name) + (c_custkey % 37) * 3 AS bytes FROM customer),
r AS (SELECT k, bytes, row_number() OVER (ORDER BY k) AS nth, sum(bytes) OVER (ORDER BY k)::BIGINT AS upto FROM c),
j AS MATERIALIZED (SELECT nth, greatest(least(max(nth) OVER (ORDER BY upto RANGE BETWEEN UNBOUNDED PRECEDING AND 2000 - bytes FOLLOWING) + 1, nth + 30), nth + 1) AS next FROM r),
s AS (SELECT 1::BIGINT AS nth UNION ALL SELECT j.next FROM s JOIN j USING (nth) WHERE j.next <= (SELECT max(nth) FROM r)),
f AS (SELECT r.*, count(s.nth) OVER (ORDER BY r.nth) AS file FROM r LEFT JOIN s USING (nth))
SELECT file, count(*) AS n, sum(bytes)::BIGINT AS bytes, min(k) AS first_key, max(k) AS last_key FROM f GROUP BY file
""")
def file_limits(spark, d):
    """Files of at most 30 rows and 2,000 bytes in key order; both limits bind."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.length("c_name") + (F.col("c_custkey") % 37) * 3).cast("long").alias("bytes"))
    rows = file_numbers(c, [F.col("k")], F.col("bytes"), 30, 2000)
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("k").alias("first_key"), F.max("k").alias("last_key"))


@query("""
SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS n_open FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1 HAVING count(*) >= 8
""")
def city_split(spark, d):
    """Cities with at least eight rows."""
    return A.city_summary(read(spark, d, "customer"), "c_nationkey", 8, F.col("c_acctbal") > 0)


@query("""
WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT * FROM (SELECT l_partkey, l_suppkey, n, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS INTEGER) AS rank FROM c) WHERE rank <= 2
""")
def provider_ranks(spark, d):
    """Each part's two main suppliers by count, then key."""
    return A.providers_of(read(spark, d, "lineitem"), ["l_partkey"], "l_suppkey").where("rank <= 2")


@query("""
SELECT o_custkey, count(*) AS n, bool_and(o_orderdate < TIMESTAMP '1998-01-01') AS all_ended FROM orders GROUP BY 1 HAVING bool_and(o_orderdate < TIMESTAMP '1998-01-01') AND count(*) <= 2
""")
def thin_pages(spark, d):
    """Pages with at most two rows that have all ended."""
    return A.thin_groups(read(spark, d, "orders"), ["o_custkey"], F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS opens, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS closes FROM orders),
s AS (SELECT *, CASE WHEN closes < '1997-06-01' THEN 'closed' WHEN opens > '1997-06-01' THEN 'upcoming' ELSE 'open' END AS status FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE status WHEN 'open' THEN 0 WHEN 'upcoming' THEN 1 ELSE 2 END, CASE WHEN status = 'upcoming' THEN opens ELSE closes END, opens, o_orderkey) AS rank FROM s)
SELECT o_custkey, o_orderkey, status, opens, closes, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2
""")
def enrol_deadlines(spark, d):
    """Each customer's two most pressing orders by enrolment phase and deadline."""
    from ..functions.dates import status_of

    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", day("o_orderdate").alias("opens"), day(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("closes"))
    o = o.withColumn("status", status_of(F.col("opens"), F.col("closes"), F.lit("1997-06-01")))
    return Wn.top_k(o, ["o_custkey"], [*Wn.by_enrol_deadline(F.col("status"), F.col("opens"), F.col("closes"), F.col("opens")), F.col("o_orderkey")], 2, "rank").select("o_custkey", "o_orderkey", "status", "opens", "closes", "rank")


@query("""
WITH y AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y FROM orders)
SELECT o_custkey, o_orderkey, CAST(y AS INTEGER) AS y FROM (SELECT *, max(y) OVER (PARTITION BY o_custkey) AS m FROM y) WHERE y = m
""")
def rows_of_latest_term(spark, d):
    """All of a customer's orders in the latest year it has."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    return Wn.rows_of_max(o, ["o_custkey"], "y")


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS last_mark,
  first_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER w AS first_mark
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def running_state(spark, d):
    """State as of each event: the last mark carried forward, and the first one known."""
    e = read(spark, d, "events").withColumn("a", F.when(F.col("event_type") == "purchase", F.col("event_id"))).withColumn("b", F.when(F.col("value") > 50, F.col("event_id")))
    order = [F.col("ts"), F.col("event_id")]
    state = running(e, ["user_id"], order, {"last_mark": ("last", F.col("a")), "first_mark": ("first", F.col("b"))})
    return state.select("event_id", "user_id", "last_mark", "first_mark")


@query("""
WITH f AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_quantity / 50.0 AS ratio FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 0 AND (l_quantity <= 3 OR l_quantity / 50.0 < 0.3)),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY ratio, l_orderkey, l_linenumber) AS k FROM f)
SELECT l_suppkey, l_orderkey, l_linenumber, ratio FROM r WHERE k <= 2 ORDER BY ratio, l_orderkey, l_linenumber LIMIT 12
""")
def almost_full(spark, d):
    """The twelve open rows with the fewest seats left, at most two a venue."""
    from ..operators.rules import nearly_full

    l = read(spark, d, "lineitem").where(nearly_full(F.when(F.col("l_linestatus") == "O", "open"), F.col("l_quantity"), F.lit(50.0)))
    l = l.withColumn("ratio", F.col("l_quantity") / 50.0)
    order = [F.col("ratio"), F.col("l_orderkey"), F.col("l_linenumber")]
    return Wn.capped_pick(l, ["l_orderkey", "l_linenumber"], ["l_suppkey"], order, 2, 12).select("l_suppkey", "l_orderkey", "l_linenumber", "ratio")


@query("""
SELECT n_name, round(min(c_acctbal), 5) AS low, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def map_rows(spark, d):
    """One row a place: a coordinate to five places, rows and open rows."""
    j = _orders_by_place(spark, d)
    return j.groupBy("n_name").agg(F.round(F.min("c_acctbal"), 5).alias("low"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))


@query("""
WITH e AS (SELECT user_id, isodow(ts) AS wd, strftime(ts, '%H:%M') AS hm FROM events)
SELECT user_id, count(*) FILTER (wd >= 6) AS weekend, count(*) FILTER (wd < 6 AND hm >= '18:00') AS evening, count(*) FILTER (wd < 6 AND hm < '18:00') AS daytime FROM e GROUP BY user_id
""")
def slot_kinds(spark, d):
    """Weekend, evening and daytime rows of each user."""
    from ..functions.dates import slot_kind

    e = read(spark, d, "events").withColumn("kind", slot_kind(F.weekday("ts") + 1, F.date_format("ts", "HH:mm")))
    return e.groupBy("user_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("weekend", "evening", "daytime")])


@query("""
SELECT count(*) AS n, count(*) FILTER (o_orderdate > TIMESTAMP '1998-01-01') AS new_rows, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(DISTINCT o_custkey) AS providers, strftime(max(o_orderdate), '%Y-%m-%d') AS updated FROM orders
""")
def home_totals(spark, d):
    """Totals of the front page."""
    o = read(spark, d, "orders")
    return o.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp_ntz")).alias("new_rows"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_distinct("o_custkey").alias("providers"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("updated"))


@query("""
WITH t AS (SELECT a.p_partkey, b.p_partkey AS other, CASE WHEN a.p_brand = b.p_brand THEN 0 WHEN a.p_size = b.p_size THEN 1 ELSE 2 END AS tier FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, other) AS rank FROM t)
SELECT p_partkey, other, tier, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8
""")
def same_title_related(spark, d):
    """Eight rows of the same title: the same provider's first, then the same city's."""
    p = read(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    return J.tiered_fill(p, "p_partkey", [["p_type", "p_brand"], ["p_type", "p_size"], ["p_type"]], ["p_partkey"], 8)


@query("""
SELECT CAST(isodow(ts) AS INTEGER) AS weekday, strftime(ts, '%H:00') AS start, count(DISTINCT user_id) AS n_users, count(*) AS n FROM events GROUP BY 1, 2
""")
def timetable(spark, d):
    """Weekday and hour cells with their distinct users."""
    e = read(spark, d, "events").select((F.weekday("ts") + 1).alias("weekday"), F.date_format("ts", "HH:00").alias("start"), "user_id")
    return e.groupBy("weekday", "start").agg(F.count_distinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS n_parts, count(*) FILTER (l_returnflag = 'R') AS n_returned, sum(CAST(l_quantity AS BIGINT))::BIGINT AS seats FROM lineitem GROUP BY 1
""")
def venue_summary(spark, d):
    """Rows, distinct providers and seat sums of each venue."""
    l = read(spark, d, "lineitem")
    return l.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("n_parts"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.sum(F.col("l_quantity").cast("long")).alias("seats"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) AS profile, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY user_id
""")
def person_profile(spark, d):
    """What each person does, most frequent first."""
    c = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "event_type", "n")))
    out = c.groupBy("user_id").agg(rows.alias("r"), F.sum("n").alias("total"))
    return out.select("user_id", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["event_type"], x["n"].cast("string"))), ",").alias("profile"), "total")


@query("""
WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT n_name, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM nation LEFT JOIN c ON n_nationkey = c.k LEFT JOIN s ON n_nationkey = s.k
""")
def district_hub(spark, d):
    """Districts with what they have, also those that have nothing."""
    n = read(spark, d, "nation")
    c = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    s = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    out = n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return out.select("n_name", F.coalesce("customers", F.lit(0).cast("long")).alias("customers"), F.coalesce("suppliers", F.lit(0).cast("long")).alias("suppliers"))


@query("""
WITH u AS (SELECT 'https://x/c/' || replace(c_name, '#', '%23') AS loc, CAST(ceil(row_number() OVER (ORDER BY 'https://x/c/' || replace(c_name, '#', '%23')) / 500.0) AS BIGINT) AS file FROM customer)
SELECT file, count(*) AS n, min(loc) AS first_loc, max(loc) AS last_loc FROM u GROUP BY file
""")
def sitemap_files(spark, d):
    """Sitemap files of 500 urls in binary order."""
    from ..functions.text import encode_uri_component

    c = read(spark, d, "customer").select(F.concat(F.lit("https://x/c/"), encode_uri_component(F.col("c_name"))).alias("loc"), F.lit(None).cast("string").alias("lastmod"))
    rows = Wn.chunk_ids(c, [F.col("loc")], 500, "file")
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("loc").alias("first_loc"), F.max("loc").alias("last_loc"))
