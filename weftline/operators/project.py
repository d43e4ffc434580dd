"""One final row per entity with its provenance, and the people that appear in it.

Which source wins a field is this library's own rule: the first value that is
there, by falling confidence, then source priority, then observation id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_all
from .rules import classify, code_map


def project(members: DataFrame, key: str, fields: list[str], source: str, record: str, confidence: str, priority: str) -> DataFrame:
    """(key, fields.., sources, rejected): best values side by side with where they come from.

    ``sources`` lists (source, record) in order of preference; ``rejected`` the
    values that lost, as (field, value, source).
    """
    order = F.struct((-F.col(confidence)).alias("c"), F.col(priority).alias("p"), F.col(record).alias("r"))
    m = members.withColumn("__o", order)
    best = m.groupBy(key).agg(
        *[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("__o"))).alias(f) for f in fields],
        F.array_sort(F.collect_set(F.struct(F.col("__o").alias("o"), F.col(source).alias("source"), F.col(record).alias("record")))).alias("__s"),
        F.collect_set(F.struct(F.col(source).alias("source"), *[F.col(f).cast("string").alias(f) for f in fields])).alias("__all"),
    )
    lost = [F.transform(F.filter("__all", _differs(f)), _losing(f)) for f in fields]
    sources = F.transform("__s", lambda x: F.struct(x["source"].alias("source"), x["record"].alias("record")))
    return best.select(key, *fields, sources.alias("sources"), F.array_sort(F.array_distinct(F.flatten(F.array(*lost)))).alias("rejected"))


def _differs(field: str):
    return lambda x: x[field].isNotNull() & (x[field] != F.col(field).cast("string"))


def _losing(field: str):
    return lambda x: F.struct(F.lit(field).alias("field"), x[field].alias("value"), x["source"].alias("source"))


def categorised(df: DataFrame, raw: Column, title: Column, by_source: dict[str, str], title_rules: list[tuple[str, str]]) -> DataFrame:
    """``df`` with category and categoryFrom: the source's own category, else the first title rule."""
    own, guessed = code_map(raw, by_source), classify(title, title_rules)
    return df.withColumn("category", F.coalesce(own, guessed)).withColumn("categoryFrom", F.when(own.isNotNull(), "source").when(guessed.isNotNull(), "title"))


#: Titles that follow or precede a name, and words that name no person.
HONORIFICS = "(老師|教練|講師|師傅|教授)"
COLLECTIVE = "(團隊|師資群|教師群|多位|待聘|未定|專業師資)"


def teacher_names(raw: Column) -> Column:
    """The persons in a teacher field: split, without nicknames and titles; groups are left out."""
    parts = F.split(F.coalesce(raw, F.lit("")), r"[、,，/／;；&＆]|\s和\s")
    clean = F.transform(parts, lambda s: trim_all(F.regexp_replace(F.regexp_replace(s, r"[(（].*?[)）]", ""), HONORIFICS, "")))
    return F.array_distinct(F.filter(clean, lambda s: (s != "") & (F.char_length(s) <= 20) & ~s.rlike(COLLECTIVE)))


def teachers(courses: DataFrame, course: str, teacher: str, provider: str, least: int = 2) -> DataFrame:
    """(name, provider, n_courses, courses): people by name and provider, with enough courses for a page."""
    rows = courses.select(course, provider, F.explode(teacher_names(F.col(teacher))).alias("name"))
    out = rows.groupBy("name", provider).agg(F.count_distinct(course).alias("n_courses"), F.array_sort(F.collect_set(course)).alias("courses"))
    return out.where(F.col("n_courses") >= least)


def same_name(people: DataFrame, provider: str) -> DataFrame:
    """People whose name also occurs at another provider."""
    many = people.groupBy("name").agg(F.count_distinct(provider).alias("n")).where("n > 1").select("name")
    return people.join(many, "name", "left_semi")
