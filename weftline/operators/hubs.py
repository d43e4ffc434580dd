"""Hubs that readers browse by, and the facts about a city."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Patterns and names of the hubs.
SENIOR_TITLE = "樂齡|銀髮|長青|熟齡|高齡者專班|銀力"
SENIOR_JOB = "高齡者專班|中高齡"
JOB_PLAN = "產業人才投資方案"
CERT_TITLE = "證照|檢定|丙級|乙級|甲級|單一級|技術士|執照|考照|證書班|認證班|堆高機|起重機|吊掛|職業安全衛生管理|安全衛生業務主管|急救人員|防火管理人|租賃住宅管理人員|照顧服務員|保母人員"
CERT_TEXT = r"(考取|取得|報考|輔導|考照|應考|參加|通過)[^。，；\n]{0,14}(證照|執照|技術士|技能檢定|檢定考|丙級|乙級|甲級|單一級)|技術士技能檢定|[乙丙]級技術士"
KID_TITLE = r"兒童|幼兒|幼童|親子|學齡|國小|小學|[低中高]年級|青少年|小朋友|寶寶|寶貝|[0-9]+\s*[-~～至]\s*[0-9]+\s*歲"
LEAST_IN_CITY = 8
LEAST_IN_DISTRICT = 10


def _says(s: Column, pattern: str) -> Column:
    return F.coalesce(s.rlike(pattern), F.lit(False))


def is_senior(kind: Column, title: Column, audience: Column) -> Column:
    """Senior centres, job training for older people, and what title or audience says elsewhere."""
    said = _says(title, SENIOR_TITLE) | _says(audience, "^樂齡")
    return F.when(kind == "senior-center", True).when(kind == "vocational", _says(title, SENIOR_JOB)).otherwise(said)


def program_of(kind: Column, plan: Column, source_ids: Column, before_job_source: str = "mol-6060") -> Column:
    """The names of the training programmes that a course belongs to."""
    bare = (kind == "vocational") & (F.coalesce(plan, F.lit("")) == "") & F.array_contains(source_ids, before_job_source)
    return F.array_compact(F.array(F.when(plan == JOB_PLAN, "產投"), F.when(_says(plan, "職前") | F.coalesce(bare, F.lit(False)), "職前訓練")))


def is_cert(title: Column, description: Column) -> Column:
    return _says(title, CERT_TITLE) | _says(description, CERT_TEXT)


def is_kids(title: Column) -> Column:
    return _says(title, KID_TITLE)


def venue_of(kind: Column, provider: Column, venue: Column) -> Column:
    """Centres that run their own place are the venue; rooms stay with the course."""
    return F.when(kind.isin("sports-center", "senior-center") & F.coalesce(provider != "", F.lit(False)), provider).otherwise(venue)


def in_page_types(path: Column, types: list[str]) -> Column:
    """Whether the first segment of a path is one of the page types."""
    return F.get(F.split(F.regexp_replace(path, "^/", ""), "/"), F.lit(0)).isin(*types) if types else F.lit(False)


def hub(df: DataFrame, member: Column, city: str, open_flag: Column, least: int = LEAST_IN_CITY) -> DataFrame:
    """(city, n, n_open): all members (city null, total), and cities with enough of them, most first."""
    rows = df.where(member).select(F.col(city).alias("city"), open_flag.cast("long").alias("open"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("open"), F.lit(0)).alias("n_open")).select(F.lit("all").alias("level"), F.lit(None).cast("string").alias("city"), "n", "n_open")
    cities = rows.where(F.coalesce(F.col("city") != "", F.lit(False))).groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.sum("open").alias("n_open")).where(F.col("n") >= least)
    return total.unionByName(cities.select(F.lit("city").alias("level"), "city", "n", "n_open"))


def by_kind(df: DataFrame, kind: str, default: str = "other") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(kind), F.lit(default)).alias(kind)).agg(F.count(F.lit(1)).alias("n"))


def city_facts(df: DataFrame, city: str, kind: str, start: str, district: str, open_flag: Column, current: Column, today: Column, kinds: list[str]) -> DataFrame:
    """(city, fact, key, n, n_current, n_open): open courses by kind and starting month, and all by district.

    Only known kinds and courses that have not begun count; ``fact`` is kind, month,
    district, or none (open courses without a district).
    """
    rows = df.select(F.col(city).alias("city"), F.col(kind).alias("k"), F.col(start).alias("s"), F.nullif(F.col(district), F.lit("")).alias("d"), open_flag.alias("o"), current.alias("c")).where("city is not null")
    fact = lambda name, key, when: F.when(when, F.struct(F.lit(name).alias("fact"), key.alias("key")))
    facts = F.array_compact(
        F.array(
            fact("kind", F.col("k"), F.col("o") & F.col("k").isin(*kinds)),
            fact("month", F.substring("s", 1, 7), F.col("o") & (F.col("s") >= today)),
            fact("district", F.col("d"), F.col("d").isNotNull()),
            fact("none", F.lit(""), F.col("o") & F.col("d").isNull()),
        )
    )
    told = rows.select("city", "o", "c", F.explode(facts).alias("f"))
    return told.groupBy("city", "f.fact", "f.key").agg(F.count(F.lit(1)).alias("n"), F.count_if("c").alias("n_current"), F.count_if("o").alias("n_open"))


def compare_cities(df: DataFrame, city: str, activity: str, open_flag: Column, current: Column, top: int = 3) -> DataFrame:
    """(city, n, n_current, n_open, activities): facts of each city with its most frequent open activities."""
    rows = df.where(F.col(city).isNotNull()).withColumns({"__o": open_flag, "__c": current})
    facts = rows.groupBy(city).agg(F.count(F.lit(1)).alias("n"), F.count_if("__c").alias("n_current"), F.count_if("__o").alias("n_open"))
    counts = rows.where(F.col("__o") & F.col(activity).isNotNull()).groupBy(city, activity).agg(F.count(F.lit(1)).alias("k"))
    first = counts.withColumn("nth", F.row_number().over(W.partitionBy(city).orderBy(F.desc("k"), activity))).where(F.col("nth") <= top)
    named = first.groupBy(city).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", activity))), lambda x: x[activity]), "|").alias("activities"))
    return facts.join(named, city, "left").withColumn("activities", F.coalesce("activities", F.lit("")))


def dominant_center(df: DataFrame, keys: list[str], kind: str, provider: str, share: float = 0.6) -> DataFrame:
    """(keys, provider, n, total) where one sports centre holds a page's share."""
    counts = df.groupBy(*keys, provider).agg(F.count(F.lit(1)).alias("all"), F.count_if((F.col(kind) == "sports-center") & F.coalesce(F.col(provider) != "", F.lit(False))).alias("n"))
    best = counts.groupBy(*keys).agg(F.max_by(F.struct(provider, "n"), F.struct(F.col("n"), F.col(provider))).alias("x"), F.sum("all").alias("total"))
    return best.select(*keys, f"x.{provider}", "x.n", "total").where((F.col("n") > 0) & (F.col("n") >= F.col("total") * share))


def with_collisions(df: DataFrame, keys: list[str], flag: str = "collide") -> DataFrame:
    """``df`` with whether another row has the same keys (null is a value of its own)."""
    return df.withColumn(flag, F.count(F.lit(1)).over(W.partitionBy(*keys)) > 1)


def last_terms(df: DataFrame, group: str, rank: Column, order: str, k: int = 1) -> DataFrame:
    """The rows of each group's k latest terms; equal terms in the given order."""
    nth = F.row_number().over(W.partitionBy(group).orderBy(rank["year"].desc(), rank["term"].desc(), F.col(order)))
    return df.withColumn("__nth", nth).where(F.col("__nth") <= k).drop("__nth")


def unique_suffix(names: DataFrame, name: str, hubs: DataFrame, hub_key: str) -> DataFrame:
    """(name, hub_key) of names that exactly one hub's key ends with, as an equi-join of endings."""
    lengths = [r[0] for r in names.select(F.length(name).alias("n")).where("n > 0").distinct().orderBy("n").collect()]
    ends = F.array_compact(F.array(*[F.when(F.length(hub_key) >= n, F.substring(F.col(hub_key), -n, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    met = hubs.select(hub_key, F.explode(ends).alias(name)).join(names.select(name).distinct(), name)
    return met.groupBy(name).agg(F.min(hub_key).alias(hub_key), F.count_distinct(hub_key).alias("__n")).where("__n = 1").drop("__n")


def digest_examples(df: DataFrame, id_col: str, n_sources: str, described: Column, almost_full: Column, k: int = 3) -> DataFrame:
    """(example, id): k described rows from the most sources (two at least), and k that are almost full."""
    many = df.where((F.col(n_sources) >= 2) & described).orderBy(F.desc(n_sources), id_col).limit(k).select(F.lit("sources").alias("example"), id_col)
    return many.unionByName(df.where(almost_full).orderBy(id_col).limit(k).select(F.lit("almost full").alias("example"), id_col))
