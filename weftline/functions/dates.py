"""Dates as ISO strings, seasons, terms and statuses.  Today is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def today_taipei() -> Column:
    return F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "Asia/Taipei"), "yyyy-MM-dd")


def season_of(date: Column) -> Column:
    m = F.month(F.to_date(date))
    return F.when(m == 1, "冬季").when(m <= 6, "春季").when(m <= 8, "暑期").when(m.isNotNull(), "秋季")


def bimonthly_term(date: Column) -> Column:
    """Year since 1911 and two-month term, as in 115-03."""
    d = F.to_date(date)
    term = F.floor((F.month(d) - 1) / 2) + 1
    return F.concat_ws("-", (F.year(d) - 1911).cast("string"), F.lpad(term.cast("string"), 2, "0"))


def roc_date(s: Column) -> Column:
    """'115.3.7', '115/03/07' or '1150307' to an ISO date."""
    loose = r"^\s*(\d{2,3})[./\-年](\d{1,2})[./\-月](\d{1,2})日?"
    tight = r"^\s*(\d{2,3})(\d{2})(\d{2})\s*$"
    part = lambda p, k: F.regexp_extract(s, p, k)
    iso = lambda p: F.concat_ws("-", (part(p, 1).try_cast("int") + 1911).cast("string"), F.lpad(part(p, 2), 2, "0"), F.lpad(part(p, 3), 2, "0"))
    return F.when(s.rlike(loose), iso(loose)).when(s.rlike(tight), iso(tight))


def ymd(s: Column) -> Column:
    """'2026/3/7', '2026-03-07' or '20260307' to an ISO date; zero dates to null."""
    loose = r"^\s*(?!0000)(\d{4})[./\-](\d{1,2})[./\-](\d{1,2})"
    tight = r"^\s*(?!0000)(\d{4})(\d{2})(\d{2})\s*$"
    part = lambda p, k: F.regexp_extract(s, p, k)
    iso = lambda p: F.concat_ws("-", part(p, 1), F.lpad(part(p, 2), 2, "0"), F.lpad(part(p, 3), 2, "0"))
    return F.when(s.rlike(loose), iso(loose)).when(s.rlike(tight), iso(tight))


def status_of(opens: Column, closes: Column, today: Column) -> Column:
    return F.when(closes < today, "closed").when(opens > today, "upcoming").when(opens.isNotNull() | closes.isNotNull(), "open").otherwise("unknown")


def has_ended(end: Column, today: Column) -> Column:
    return F.coalesce(end < today, F.lit(False))


def is_open(status: Column, end: Column, today: Column) -> Column:
    return F.coalesce(status == "open", F.lit(False)) & ~has_ended(end, today)


def is_stale(end: Column, today: Column, days: int = 365) -> Column:
    return F.coalesce(F.datediff(F.to_date(today), F.to_date(end)) >= days, F.lit(False))


def is_current(start: Column, end: Column, today: Column, days: int = 90) -> Column:
    recent = F.coalesce(start >= F.date_sub(F.to_date(today), days).cast("string"), F.lit(False))
    return ~has_ended(end, today) | recent


def is_inverted(start: Column, end: Column) -> Column:
    return F.coalesce(end < start, F.lit(False))


def in_term_window(source: Column, date: Column, windows: dict[str, list[tuple[int, int]]], default: list[tuple[int, int]]) -> Column:
    """Whether a date's month and day (as month * 100 + day) lie in a source's windows."""
    md = F.month(F.to_date(date)) * 100 + F.dayofmonth(F.to_date(date))
    within = lambda spans: F.greatest(*[md.between(a, b) for a, b in spans], F.lit(False), F.lit(False))
    out = within(default)
    for name, spans in windows.items():
        out = F.when(source == name, within(spans)).otherwise(out)
    return out


def slot_kind(weekday: Column, start: Column, evening: str = "18:00") -> Column:
    """weekend, evening or daytime; null without a weekday or time."""
    return F.when(weekday >= 6, "weekend").when(start >= evening, "evening").when(start.isNotNull(), "daytime")


def teacher_slot_kind(weekday: Column, start: Column) -> Column:
    """As for teachers: evening from 17:00, and no time counts as daytime."""
    return F.when(weekday >= 6, "weekend").when(start >= "17:00", "evening").otherwise("daytime")
