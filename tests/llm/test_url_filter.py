import re

import pytest

from weftline.llm import url_filter as u

URLS = [
    "https://www.example.com/en/7/x",
    "http://EXAMPLE.com/en/71?x=1",
    "http://a.com/en/",
    "http://acom/en/",
    "http://net/de/9",
    "http://x.example.net/de/81#t",
    "http://example.net/de/7",
    "ftp://b.org/es/1",
    "http://spam-farm.example.org/fr/1",
    "http://docs.a.b/x/sessionid=3",
    "http://z.b/x?sessionid=3",
    "no scheme here",
    "http://",
    "",
    None,
    "http://casino/x",
    "http://casinos/x",
    "a://b://com/en/",
]


def brute(url):
    host, path, text = u.split_url(url)
    fits = [(len(h + p), h + p, v) for v, h, p in u.SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return max(fits)[1:]
    hits = [r for r in map(u.pattern_rule, u.PATTERN_RULES) if re.search(r.regex, text)]
    return None, "allow" if not hits or any(r.verdict == "allow" for r in hits) else "block"


def test_matches_brute_force_with_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(URLS + URLS[:3])], "page_id long, url string, verdict string")
    rows = u.judge_urls(df).collect()
    assert len(rows) == len(URLS) + 3
    for r in rows:
        assert (r.url_verdict.rule, r.url_verdict.verdict) == brute(r.url)
        assert r.verdict == "kept"


def test_empty_table_and_no_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert u.judge_urls(empty).count() == 0
    one = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    assert u.judge_urls(one, sites=[], patterns=[]).first().url_verdict.verdict == "allow"


def test_rules_are_filed_under_their_rarest_complete_token():
    rules = u.compile_rules(u.SITE_RULES, ["*open*", "||left.*.right^"])
    index, rest = u.index_rules(rules, {"com": 100, "en": 5, "example": 3})
    assert [r.name for r in rest] == ["*open*"]
    assert "com/en/" in [r.name for r in index["en"]]
    assert "7" not in index


@pytest.mark.parametrize("url,host,path", [("a://B.c:80/x?y", "b.c:80", "/x"), ("a://b?c", "b", ""), ("x", "", ""), (None, "", "")])
def test_split(url, host, path):
    assert u.split_url(url)[:2] == (host, path)
