"""Column functions on text.  White space means Unicode white space throughout."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(c) for c in range(0x21, 0x7F))


def to_half(s: Column) -> Column:
    """Full-width ASCII to half-width."""
    return F.translate(s, _FULL, _HALF)


def trim_all(s: Column) -> Column:
    """Trim every kind of Unicode white space, not only U+0020."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def squash(s: Column) -> Column:
    """Every run of white space becomes one space; ends are trimmed."""
    return trim_all(F.regexp_replace(s, r"(?U)\s+", " "))


def no_space(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+", "")


def replace_first(s: Column, pattern: str, by: str) -> Column:
    """Replace the first match only."""
    return F.regexp_replace(s, rf"(?s)^(.*?)(?:{pattern})", "$1" + by)


def tai(s: Column) -> Column:
    return F.replace(s, F.lit("台"), F.lit("臺"))


#: The counties and cities that names start with.
COUNTIES = ("臺北市", "新北市", "桃園市", "臺中市", "臺南市", "高雄市", "基隆市", "新竹市", "嘉義市", "新竹縣", "苗栗縣", "彰化縣", "南投縣", "雲林縣", "嘉義縣", "屏東縣", "宜蘭縣", "花蓮縣", "臺東縣", "澎湖縣", "金門縣", "連江縣")
_COUNTY_PREFIX = "^(" + "|".join(COUNTIES) + ")"
#: What schools and centres end with.
SCHOOL_SUFFIXES = ("社區大學", "社大", "樂齡學習中心", "樂齡中心", "國民運動中心", "運動中心")


def without_county(s: Column) -> Column:
    return F.regexp_replace(s, _COUNTY_PREFIX, "")


def county_of(s: Column) -> Column:
    """A county's name, or null for anything else that stands in its place."""
    name = trim_all(tai(s))
    return F.when(name.isin(*COUNTIES), name)


def norm_school(s: Column) -> Column:
    """School key: half width, no spaces, without county and type; of a bare county school its place."""
    base = no_space(tai(to_half(F.coalesce(s, F.lit("")))))
    typed = F.regexp_replace(base, "(" + "|".join(SCHOOL_SUFFIXES) + ")$", "")
    core = F.regexp_replace(without_county(base), "(" + "|".join(SCHOOL_SUFFIXES) + ")$", "")
    return F.when(core != "", core).otherwise(F.regexp_replace(typed, "[縣市]$", ""))


def norm_title(s: Column) -> Column:
    """Title key: no leading label block, no remarks on weeks, terms or classes, no stars or punctuation."""
    t = to_half(F.coalesce(s, F.lit("")))
    t = F.regexp_replace(t, "^【[^】]*】", "")
    t = F.regexp_replace(t, r"(?U)[（(][^）)]*[週期班]\s*[）)]", "")
    return F.regexp_replace(t, r"(?U)[\s★☆◎※*，,。.、:：;；!！?？~～\-－—_]+", "")


def term_key(year: Column, season: Column, raw: Column) -> Column:
    """Year and season if both are there, else the raw term without spaces ('' without one)."""
    known = F.coalesce((year.cast("string") != "") & (year.cast("string") != "0") & (season != ""), F.lit(False))
    return F.when(known, F.concat(year.cast("string"), season)).otherwise(no_space(F.coalesce(raw, F.lit(""))))


def norm_venue_name(s: Column) -> Column:
    t = F.regexp_replace(tai(F.coalesce(s, F.lit(""))), r"(?U)[\s()（）]+", "")
    return F.regexp_replace(t, "^(國立|市立|縣立|私立|公立)", "")


def hash8(s: Column) -> Column:
    return F.substring(F.sha2(s, 256), 1, 8)


def clip(s: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(s, 1, n)


def truncate(s: Column, n: int = 200) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def strip_promo_prefix(s: Column) -> Column:
    """Drop leading label blocks, unless nothing else would be left."""
    left = trim_all(F.regexp_replace(s, r"(?U)^(\s*[【\[［][^】\]］]*[】\]］]\s*)+", ""))
    last = F.regexp_extract(s, r"(?U)([【\[［][^】\]］]*[】\]］])\s*$", 1)
    return F.when(left != "", left).otherwise(last)


MAX_TITLE = 20
MAX_PROVIDER = 12


def short_provider(s: Column) -> Column:
    """A provider without legal form and county, its type shortened, letters and digits only."""
    t = tai(no_space(to_half(nfc(F.coalesce(s, F.lit(""))))))
    t = without_county(F.regexp_replace(t, "^(財團法人|社團法人)", ""))
    for long, short in (("社區大學", "社大"), ("樂齡學習中心", "樂齡中心"), ("國民運動中心", "運動中心")):
        t = F.regexp_replace(t, f"{long}$", short)
    t = F.regexp_replace(t, "(股份有限公司|有限公司|基金會附設|財團法人)$", "")
    return clip(normalize_name(t), MAX_PROVIDER)


def _or(s: Column, default: str) -> Column:
    return F.when(s != "", s).otherwise(F.lit(default))


def course_slug_base(title: Column, provider: Column) -> Column:
    """Readable part of a course's address: title and provider."""
    name = _or(clip(normalize_name(strip_promo_prefix(F.coalesce(title, F.lit("")))), MAX_TITLE), "課程")
    by = short_provider(provider)
    return F.when(by != "", F.concat_ws("-", name, by)).otherwise(name)


def venue_slug_base(name: Column) -> Column:
    bare = F.regexp_replace(no_space(nfc(F.coalesce(name, F.lit("")))), "^(財團法人|社團法人)", "")
    return _or(clip(normalize_name(bare), MAX_TITLE), "場館")


def teacher_slug_base(name: Column, provider: Column) -> Column:
    who = _or(clip(normalize_name(F.coalesce(name, F.lit(""))), MAX_TITLE), "講師")
    by = short_provider(provider)
    return F.when(by != "", F.concat_ws("-", who, by)).otherwise(who)


def html_text(s: Column) -> Column:
    """Text of an HTML fragment: no scripts or styles, tags to spaces, entities last."""
    t = F.regexp_replace(s, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(value))
    return squash(t)


def plain_text(s: Column) -> Column:
    """Visible text of a whole page: also without head and doctype."""
    t = F.regexp_replace(s, r"(?is)<head[^>]*>.*?</head>|<!doctype[^>]*>", " ")
    return html_text(t)


@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    """All named and numeric character references."""
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, which has no built-in function."""
    return s.map(lambda x: x if x.isascii() else unicodedata.normalize("NFC", x), na_action="ignore")


def normalize_name(s: Column) -> Column:
    return F.regexp_replace(to_half(nfc(s)), r"[^\p{L}\p{N}]+", "")


def encode_uri_component(s: Column) -> Column:
    t = F.url_encode(s)
    for name, value in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        t = F.replace(t, F.lit(name), F.lit(value))
    return t


def encode_path(s: Column) -> Column:
    """Percent-encode every segment of a path."""
    return F.array_join(F.transform(F.split(s, "/"), encode_uri_component), "/")


def xml_escape(s: Column) -> Column:
    t = s
    for name, value in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        t = F.replace(t, F.lit(name), F.lit(value))
    return t


def fmt_count(n: Column) -> Column:
    return F.format_number(n, 0)


def fmt_duration(ms: Column) -> Column:
    """Days, hours or minutes, whichever is the largest whole unit."""
    minute, hour, day = 60_000, 3_600_000, 86_400_000
    part = lambda unit, mark: F.concat(F.round(ms / unit, 1).cast("decimal(18,1)").cast("string"), F.lit(mark))
    return F.when(ms >= day, part(day, "d")).when(ms >= hour, part(hour, "h")).otherwise(part(minute, "m"))


def paragraphs(s: Column, mark: str = r"\^") -> Column:
    """Split at a mark, trim, drop blanks, join with line breaks."""
    return F.array_join(F.filter(F.transform(F.split(s, mark), trim_all), lambda x: x != ""), "\n")


def describe(*parts: Column) -> Column:
    """The parts that are there, as one sentence."""
    return F.concat_ws("，", *[F.when(p != "", p) for p in parts])


#: Words that mark a bracket as a remark on a run of a course, and the units runs are numbered by.
_RUN_REMARKS = ("開課", "期", "梯")
_RUN = "第?(?U:\\s*)[0-9０-９一二三四五六七八九十]+(?U:\\s*)(?:期|梯)次?"


def title_key(s: Column) -> Column:
    """Series key of a title: no remarks or numbers of its runs, no punctuation, symbols or space."""
    remark = rf"[【\[(（][^】\])）]*(?:{'|'.join(_RUN_REMARKS)})[^】\])）]*[】\])）]"
    t = F.regexp_replace(F.coalesce(s, F.lit("")), f"{remark}|{_RUN}", "")
    return F.lower(F.regexp_replace(t, r"(?U)[\s\p{P}\p{S}]+", ""))


def obs_key(source: Column, record: Column) -> Column:
    return F.concat(source, F.lit(":"), record)


def rlike_any(s: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | s.rlike(p)
    return F.coalesce(out, F.lit(False))
