"""What readers see: short place names, titles, blurbs, hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import season_of
from .text import fmt_count

#: Status to (priority, change frequency) of a page.
HINTS = {"open": ("0.9", "daily"), "upcoming": ("0.7", "weekly"), "full": ("0.6", "weekly"), "running": ("0.6", "weekly"), "unknown": ("0.5", "weekly"), "closed": ("0.3", "monthly"), "cancelled": ("0.2", "monthly")}
#: Labels of times of day, in the order they are told.
TIMES = (("weekend", "週末"), ("evening", "平日晚上"), ("daytime", "平日白天"))
_PLAIN_CITIES = "臺北|台北|新北|桃園|臺中|台中|臺南|台南|高雄|基隆|新竹|嘉義|宜蘭|花蓮|臺東|台東|屏東|彰化|雲林|南投|苗栗|澎湖|金門|連江"


def _plain_tai(s: Column) -> Column:
    return F.replace(F.coalesce(s, F.lit("")), F.lit("臺"), F.lit("台"))


def short_city(city: Column) -> Column:
    """A county as people say it; two names need their ending to be told apart."""
    s = F.regexp_replace(F.coalesce(city, F.lit("")), "^臺", "台")
    return F.when(s.rlike("^(嘉義|新竹)"), s).otherwise(F.regexp_replace(s, "[市縣]$", ""))


def short_district(district: Column) -> Column:
    d = F.coalesce(district, F.lit(""))
    return F.when(F.char_length(d) > 2, F.regexp_replace(d, "[區鎮鄉市]$", "")).otherwise(d)


def short_center(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, f"^({_PLAIN_CITIES})[市縣]立?", ""), "國民暨兒童運動中心|國民運動中心", "運動中心")


def mentions_city(text: Column, city: Column) -> Column:
    """Whether a text already names the county, in either spelling."""
    root = F.regexp_replace(_plain_tai(city), "[市縣]$", "")
    return F.coalesce(city != "", F.lit(False)) & F.contains(_plain_tai(text), root)


def year_season(date: Column) -> Column:
    """As in '2026 秋季'; null without a date."""
    return F.concat(F.substring(date, 1, 4), F.lit(" "), season_of(date))


def course_title(title: Column, provider: Column, city: Column, start: Column, slot: Column, collide: Column) -> Column:
    """Title, provider, county if the provider does not name it, season, and the first slot where titles collide."""
    p, has = F.coalesce(provider, F.lit("")), F.coalesce(city != "", F.lit(False))
    place = F.when(has & ~mentions_city(p, city), F.when(p != "", F.concat(F.lit("（"), short_city(city), F.lit("）"))).otherwise(F.concat(F.lit("｜"), city)))
    parts = [title, F.when(p != "", F.concat(F.lit("｜"), p)), place, F.concat(F.lit(" "), year_season(start)), F.when(collide, F.concat(F.lit(" "), slot))]
    return F.concat(*[F.coalesce(x, F.lit("")) for x in parts])


#: What a house number is written with, what ways and places end with, and what only names hold.
_HOUSE = "[0-9０-９、,之至附－\\-]+號"
_WAY_ENDS, _PLACE_ENDS = "路|街|大道|段|巷|弄|村|里|鄰", "縣市區鄉鎮村里鄰"
_NAME_MARKS = "：:—（(【"


def is_bare_address(name: Column) -> Column:
    """A name that is only an address: a house number behind a way, or up to four characters behind a place."""
    before = f"(?:{_WAY_ENDS}|[{_PLACE_ENDS}][^{_PLACE_ENDS}]{{1,4}})"
    return F.coalesce(name.rlike(f"^[^{_NAME_MARKS}\\-]*?{before}臨?{_HOUSE}[^{_NAME_MARKS}\\-]*$") & name.rlike("[0-9]+號"), F.lit(False))


def venue_heading(name: Column, override: Column, providers: Column, total: Column, share: float = 0.6) -> Column:
    """A venue's heading: an override, its own name, or its address with who teaches there.

    ``providers`` is an array of (name, n), most first.
    """
    bare, first = is_bare_address(name), F.get(providers, F.lit(0))
    few = F.array_join(F.transform(F.slice(providers, 1, 2), lambda p: p["name"]), "、")
    more = F.when(F.size(providers) > 2, F.concat(F.lit("等 "), F.size(providers).cast("string"), F.lit(" 個單位"))).otherwise(F.lit(""))
    own = F.when(~bare, name).when(first["n"] >= total * share, F.concat(name, F.lit("（"), first["name"], F.lit("上課地點）")))
    own = own.when(F.size(providers) > 0, F.concat(name, F.lit("（"), few, more, F.lit("的上課地點）"))).otherwise(name)
    return F.when(override.isNotNull(), F.when(bare, F.concat(override, F.lit("（"), name, F.lit("）"))).otherwise(override)).otherwise(own)


def facts_blurb(counts: dict[str, Column], priced: Column, least: Column, most: Column, free: Column) -> Column:
    """Counts by time of day, the price range and free courses, as one phrase; '' if there is nothing to say."""
    when = F.concat_ws("、", *[F.when(counts[k] > 0, F.concat(F.lit(f"{label} "), fmt_count(counts[k]), F.lit(" 門"))) for k, label in TIMES])
    span = F.when(least == most, F.concat(fmt_count(least), F.lit(" 元"))).otherwise(F.concat(fmt_count(least), F.lit("–"), fmt_count(most), F.lit(" 元")))
    prices = F.when(priced > 0, F.concat(F.lit("有標價的 "), fmt_count(priced), F.lit(" 門 "), span))
    return F.concat_ws("，", F.nullif(when, F.lit("")), prices, F.when(free > 0, F.concat(F.lit("免費 "), fmt_count(free), F.lit(" 門"))))


def page_hint(status: Column) -> Column:
    """(priority, changefreq) of a page by its course's status; others count as unknown."""
    out = F.struct(F.lit(HINTS["unknown"][0]).alias("priority"), F.lit(HINTS["unknown"][1]).alias("changefreq"))
    for name, (priority, freq) in HINTS.items():
        out = F.when(status == name, F.struct(F.lit(priority).alias("priority"), F.lit(freq).alias("changefreq"))).otherwise(out)
    return out


def latest(dates: Column) -> Column:
    """The largest date of an array that is not blank."""
    return F.array_max(F.filter(dates, lambda d: F.coalesce(d != "", F.lit(False))))


def semester_rank(label: Column) -> Column:
    """(year, term) of a semester label, so that labels can be ordered; a season's word beats its number."""
    nth = F.regexp_extract(label, r"第\s*([1-4一二三四])\s*學期", 1)
    nth = F.when(nth != "", F.translate(nth, "一二三四", "1234")).otherwise(F.regexp_extract(label, r"-\s*([1-4])", 1))
    term = F.when(label.contains("秋"), 2.0).when(label.contains("春"), 1.0).when(label.contains("暑"), 1.5).when(label.contains("寒"), 2.5).otherwise(F.coalesce(nth.try_cast("double"), F.lit(0.0)))
    return F.struct(F.coalesce(F.regexp_extract(label, r"(\d{3})", 1).try_cast("int"), F.lit(0)).alias("year"), term.alias("term"))
