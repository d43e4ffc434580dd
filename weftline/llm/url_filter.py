"""URL filters: rules indexed by their rarest literal token.

A rule set has two kinds of rules.  *Site rules* (host and path prefix, allow
or block) fit a host with all its subdomains; the longest fitting one decides.
*Pattern rules* decide where no site rule fits: ``||`` anchors at a host label,
``|`` at either end, ``*`` is any run and ``^`` a separator or the end; ``@@``
marks an exception, which beats every blocking pattern.

Every rule is filed under one literal token: the one among its complete tokens
(runs of letters and digits that no open end can extend) that the fewest urls
hold, by counts over the whole column.  A url's own tokens fetch candidate
rules, and only those run their regular expression.  Rules that have no
complete token are tried on every url.

Rules are a driver-side argument, so their index is as small as that argument.
The urls themselves are never shuffled: each is judged where it was read.

Urls are judged whole, however long.

Edge cases: a null url, or one without ``://``, has an empty host and path and
fits no site rule; it is judged by the patterns that fit an empty text (none).
Repeated rows are judged alike, one output row for each input row; an empty table
gives an empty result.  Columns of
the input stay; ``out`` replaces a column of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (verdict, host, path prefix)
SITE_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

PATTERN_RULES = (
    "||spam-farm.",
    "||cheap-pills.",
    "||casino^",
    "||poker-*.example.",
    "/adclick^",
    "/wp-login.php|",
    "sessionid=",
    "@@||docs.*/sessionid=",
)

VERDICT = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("tried", T.IntegerType()),
    ]
)

_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class Rule:
    """One rule with its regular expression and its complete literal tokens."""

    name: str
    verdict: str
    site: bool
    regex: str
    tokens: tuple[str, ...]
    rank: tuple


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host, path, and the text that patterns run on (all from after ``://``)."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", ""
    end = re.search(r"[/?#]", rest)
    host = rest[: end.start()] if end else rest
    tail = rest[len(host) :]
    stop = re.search(r"[?#]", tail)
    path = tail[: stop.start()] if stop else tail
    host = host.translate(_LOWER)
    return host, path, host + tail.translate(_LOWER)


def site_rule(verdict: str, host: str, path: str) -> Rule:
    regex = rf"(?s)\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    text = (host + path).translate(_LOWER)
    complete = tuple(m.group() for m in _TOKEN.finditer(text) if m.end() < len(text))
    return Rule(host + path, verdict, True, regex, complete, (len(host + path), len(host), verdict))


def pattern_rule(pattern: str) -> Rule:
    verdict, body = ("allow", pattern[2:]) if pattern.startswith("@@") else ("block", pattern)
    at_host, body = body.startswith("||"), body.removeprefix("||")
    at_start, body = (not at_host) and body.startswith("|"), body.removeprefix("|")
    at_end, body = body.endswith("|"), body.removesuffix("|")
    body = body.translate(_LOWER)
    start = r"\A(?:[^/?#]*\.)?" if at_host else r"\A" if at_start else ""
    parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\Z)"}
    regex = "(?s)" + start + "".join(parts.get(c, re.escape(c)) for c in body) + (r"\Z" if at_end else "")
    complete = []
    for m in _TOKEN.finditer(body):
        left = body[m.start() - 1] != "*" if m.start() else at_host or at_start
        right = body[m.end()] != "*" if m.end() < len(body) else at_end
        if left and right:
            complete.append(m.group())
    return Rule(pattern, verdict, False, regex, tuple(complete), (verdict == "allow", len(body), pattern))


def compile_rules(sites: Sequence[tuple[str, str, str]], patterns: Sequence[str]) -> list[Rule]:
    return [site_rule(*s) for s in sites] + [pattern_rule(p) for p in patterns]


def token_counts(df: DataFrame, url_col: str, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many urls each token of a rule occurs, over the whole column.

    At most one row for each token of a rule reaches the driver.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    spark = df.sparkSession
    text = F.lower(F.substring_index(F.concat(F.lit("://"), F.coalesce(F.col(url_col), F.lit(""))), "://", -1))
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)))
    listed = spark.createDataFrame([(t,) for t in wanted], "token string")
    rows = df.select(F.explode(tokens).alias("token")).join(listed, "token").groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def index_rules(rules: Sequence[Rule], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Token to rules, and the rules without a complete token."""
    index: dict[str, list[Rule]] = {}
    rest = []
    for rule in rules:
        if rule.tokens:
            rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
            index.setdefault(rarest, []).append(rule)
        else:
            rest.append(rule)
    return index, rest


def judge(url, index, rest, default="allow", compiled: dict[str, re.Pattern] | None = None) -> tuple:
    """Host, path, site rule, pattern, verdict and how many expressions ran.

    ``compiled`` keeps the expressions of one task's rules, each compiled when first run.
    """
    compiled = {} if compiled is None else compiled

    def fits_rule(r: Rule) -> bool:
        if r.regex not in compiled:
            compiled[r.regex] = re.compile(r.regex)
        return compiled[r.regex].search(host + path if r.site else text) is not None

    host, path, text = split_url(url)
    found = [r for t in dict.fromkeys(_TOKEN.findall(text)) for r in index.get(t, ())]
    tried = found + rest
    fits = [r for r in tried if fits_rule(r)]
    site = max((r for r in fits if r.site), key=lambda r: r.rank, default=None)
    pattern = max((r for r in fits if not r.site), key=lambda r: r.rank, default=None)
    verdict = site.verdict if site else pattern.verdict if pattern else default
    return host, path, site and site.name, pattern and pattern.name, verdict, len(tried)


def judge_urls(
    df: DataFrame,
    url_col: str = "url",
    sites: Sequence[tuple[str, str, str]] = SITE_RULES,
    patterns: Sequence[str] = PATTERN_RULES,
    default: str = "allow",
    out: str = "url_verdict",
) -> DataFrame:
    """``df`` with a struct column ``out``: host, path, rule, pattern, verdict, tried."""
    rules = compile_rules(sites, patterns)
    index, rest = index_rules(rules, token_counts(df, url_col, rules))

    @F.pandas_udf(VERDICT)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled: dict[str, re.Pattern] = {}
        for urls in batches:
            rows = [judge(u, index, rest, default, compiled) for u in urls]
            yield pd.DataFrame(rows, columns=VERDICT.names).astype({"tried": "int32"})

    return df.withColumn(out, judged(F.col(url_col)))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url judged by the given site rules, else by the patterns."""
    from .scratch import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    j = F.col("url_verdict")
    return judge_urls(pages).select("page_id", j.host.alias("host"), j.path.alias("path"), j.rule.alias("rule"), j.verdict.alias("verdict"), j.pattern.alias("pattern"))


def _oracle() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in SITE_RULES)
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pats = [pattern_rule(p) for p in PATTERN_RULES]
    cases = "\n".join(
        f"    WHEN regexp_matches(full_text, '{r.regex.replace(chr(92) + 'Z', chr(92) + 'z')}') THEN '{r.name}'"
        for r in sorted(pats, key=lambda r: r.rank, reverse=True)
    )
    return f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {rules}),
rest AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r,
  row_number() OVER () AS k FROM pages),
cutup AS (SELECT *, translate(regexp_extract(r, '^[^/?#]*'), '{up}', '{low}') AS host,
  regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
  translate(r, '{up}', '{low}') AS full_text FROM rest),
fit AS (SELECT c.k, rules.*, row_number() OVER (PARTITION BY c.k ORDER BY length(rhost || rpath) DESC) AS n
  FROM cutup c JOIN rules ON (c.host = rhost OR ends_with(c.host, '.' || rhost)) AND starts_with(c.path, rpath)),
pat AS (SELECT *, CASE
{cases}
    ELSE NULL END AS pattern FROM cutup)
SELECT p.page_id, p.host, p.path, f.rhost || f.rpath AS rule,
  coalesce(f.verdict, CASE WHEN p.pattern IS NULL OR starts_with(p.pattern, '@@') THEN 'allow' ELSE 'block' END) AS verdict,
  p.pattern
FROM pat p LEFT JOIN fit f ON f.k = p.k AND f.n = 1
"""


ORACLE = _oracle()
