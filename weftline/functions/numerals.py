"""Chinese numerals and addresses.

An address is read by a small grammar: a text is cut into its parts once, and every
result is put together from those parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import chain, let

#: Digits and units of Chinese numerals.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100}
_FROM, _TO = "".join(DIGITS), "".join(str(n) for n in DIGITS.values())


def cn_to_int(s: Column) -> Column:
    """A Chinese numeral up to 999; null if it holds any other character."""
    start = F.struct(F.lit(0).alias("total"), F.lit(None).cast("int").alias("now"))

    def step(acc: Column, c: Column) -> Column:
        unit = F.when(c == "十", 10).when(c == "百", 100)
        total = acc["total"] + F.coalesce(F.coalesce(acc["now"], F.lit(1)) * unit, F.lit(0))
        return F.struct(total.alias("total"), F.when(unit.isNotNull(), 0).otherwise(c.try_cast("int")).alias("now"))

    known = "^[" + "".join([*DIGITS, *UNITS]) + "]+$"
    value = lambda x: F.when(x.rlike(known), F.aggregate(F.split(F.translate(x, _FROM, _TO), ""), start, step, lambda acc: acc["total"] + F.coalesce(acc["now"], F.lit(0))))
    return let(s, value)


_TENS, _HUNDREDS = "[零〇一二三四五六七八九十]+", "[零〇一二三四五六七八九十百]+"
#: way, section, way behind it, number in digits, its branch, number in words
_DOOR = f"(?s)^(.*?)(?:({_TENS})段(.*?))?(?:([0-9]+)(?:[-~之]([0-9]+))?|({_HUNDREDS}))號"
_SECTION = f"(?s)^(.*?)({_TENS})段(.*)$"
#: What is written in several ways: digits, dashes, brackets, colons and one character.
_MANY, _ONE = "０１２３４５６７８９－（）：台", "0123456789-():臺"


def plain_address(raw: Column) -> Column:
    """One spelling of every character, no white space; '' for null."""
    return F.regexp_replace(F.translate(F.coalesce(raw, F.lit("")), _MANY, _ONE), r"(?U)\s+", "")


def door(s: Column) -> Column:
    """``s`` up to its house number, section and number in digits, or null without a number."""
    part = lambda x, k: F.regexp_extract(x, _DOOR, k)
    parts = lambda x: F.array(*[part(x, k) for k in range(1, 7)])

    def together(p: Column) -> Column:
        way, section, behind, number, branch, words = (p[k] for k in range(6))
        figures = F.transform(F.array(section, words), lambda x: cn_to_int(x).cast("string"))
        of = lambda n: F.concat(way, F.coalesce(F.concat(n[0], F.lit("段"), behind), F.lit("")), F.coalesce(n[1], number), F.when(branch != "", F.concat(F.lit("之"), branch)).otherwise(""), F.lit("號"))
        return let(figures, of)

    return let(s, lambda x: F.when(x.rlike(_DOOR), let(parts(x), together)))


def norm_address(raw: Column) -> Column:
    """The key under which equal addresses meet; '' without an address.

    Half-width digits, no white space, zip code or brackets, section and house number
    in digits, "12-3號" as "12之3號", nothing behind the house number.
    """
    section = lambda x: F.when(x.rlike(_SECTION), F.concat(F.regexp_extract(x, _SECTION, 1), cn_to_int(F.regexp_extract(x, _SECTION, 2)).cast("string"), F.lit("段"), F.regexp_extract(x, _SECTION, 3))).otherwise(x)
    bare = lambda x: F.regexp_replace(x, r"^[0-9]{3,6}|\([^)]*\)?", "")
    return chain(plain_address(raw), bare, lambda x: F.coalesce(door(x), section(x)))
