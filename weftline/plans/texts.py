"""Text, page and JSON reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import quality as Q
from ..operators import rules as Ru
from .registry import read, registrar

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)


@query(r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\s\x{00A0}\x{3000}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{1680}\x{0085}]+', ' ', 'g')) AS body FROM pages
""")
def html_text(spark, d):
    """The text of every page."""
    return read(spark, d, "pages").select("page_id", X.html_text(F.col("html")).alias("body"))


@query(r"""
WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=["'']([^"''#]+)', 1)) AS href FROM pages)
SELECT page_id, href FROM l WHERE href NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)
""")
def link_check(spark, d):
    """Links that lead to no known page."""
    return Q.broken_links(read(spark, d, "pages"), "html", "page_id", "url").select("page_id", "href")


_LABELS = [
    {"name": "greeting", "match": "hello|bonjour|hola"},
    {"name": "shout", "match": "!!"},
    {"name": "table", "match": r"\|", "exclude": "http"},
    {"name": "article", "match": r"\b(the|der|les)\b"},
    {"name": "secret", "match": r"password|token", "category": "^en$", "category_match": "api"},
]


@query(r"""
SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)hello|bonjour|hola') THEN 'greeting' END, CASE WHEN regexp_matches(text, '(?i)!!') THEN 'shout' END,
  CASE WHEN regexp_matches(text, '(?i)\|') AND NOT regexp_matches(text, '(?i)http') THEN 'table' END, CASE WHEN regexp_matches(text, '(?i)\b(the|der|les)\b') THEN 'article' END,
  CASE WHEN regexp_matches(text, '(?i)password|token') OR (regexp_matches(text, '(?i)api') AND regexp_matches(lang, '(?i)^en$')) THEN 'secret' END) AS labels,
  CASE WHEN regexp_matches(text, '!!') THEN 'loud' WHEN regexp_matches(text, '\|') THEN 'tabular' WHEN regexp_matches(text, '[0-9]{4}') THEN 'numeric' ELSE 'prose' END AS kind
FROM documents
""")
def rule_labels(spark, d):
    """All labels that fit a document, and the first class that does."""
    docs = read(spark, d, "documents")
    found = Ru.labels(F.col("text"), F.col("lang"), _LABELS)
    kind = Ru.classify(F.col("text"), [("!!", "loud"), (r"\|", "tabular"), ("[0-9]{4}", "numeric")], "prose")
    return docs.select("doc_id", F.array_join(found, ",").alias("labels"), kind.alias("kind"))


@query("""SELECT doc_id, source, lang FROM documents WHERE contains(text, 'est') OR contains(source, 'est') OR contains(lang, 'est') ORDER BY doc_id LIMIT 200""")
def search_contains(spark, d):
    """The first 200 documents with a substring in any of the searched columns."""
    docs = read(spark, d, "documents")
    return docs.where(Ru.contains_any(F.lit("est"), F.col("text"), F.col("source"), F.col("lang"))).select("doc_id", "source", "lang").orderBy("doc_id").limit(200)


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events""")
def json_props(spark, d):
    """A field of every event's JSON."""
    e = read(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), "event_type")


@query("""
SELECT conv_id, count(*) AS n_turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, left(arg_min(text, turn), 60) AS opening, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM conversations GROUP BY conv_id
""")
def conversation_first(spark, d):
    """First and last turn of every conversation."""
    c = read(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.substring(F.min_by("text", "turn"), 1, 60).alias("opening"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query(r"""
SELECT c_custkey, left(c_name, 12) AS clipped, replace(replace(replace(replace(replace(c_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped,
  concat_ws('，', c_mktsegment, CASE WHEN c_acctbal > 0 THEN 'in credit' END) AS described, CASE WHEN length(c_name) > 10 THEN left(c_name, 9) || '…' ELSE c_name END AS short FROM customer
""")
def text_projection(spark, d):
    """Display fields of a row: clipped, escaped, described, truncated."""
    c = read(spark, d, "customer")
    name = F.col("c_name")
    return c.select("c_custkey", X.clip(name, 12).alias("clipped"), X.xml_escape(name).alias("escaped"), X.describe(F.col("c_mktsegment"), F.when(F.col("c_acctbal") > 0, "in credit")).alias("described"), X.truncate(name, 10).alias("short"))


@query("""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, CASE WHEN month(any_value(o_orderdate)) = 1 THEN '冬季' WHEN month(any_value(o_orderdate)) <= 6 THEN '春季' WHEN month(any_value(o_orderdate)) <= 8 THEN '暑期' ELSE '秋季' END AS season,
  (year(any_value(o_orderdate)) - 1911)::VARCHAR || '-' || lpad(((month(any_value(o_orderdate)) - 1) // 2 + 1)::VARCHAR, 2, '0') AS term FROM orders GROUP BY 1
""")
def season_terms(spark, d):
    """Season and two-month term of every day."""
    from ..functions.dates import bimonthly_term, season_of

    o = read(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return o.select("day", "n", season_of(F.col("day")).alias("season"), bimonthly_term(F.col("day")).alias("term"))
