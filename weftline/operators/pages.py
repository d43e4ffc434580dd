"""Topics, college hubs, breadcrumbs, and checks of sitemaps and linked-data documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import encode_path, xml_escape
from .lineage import cut

#: What sitemaps and documents may say.
FREQUENCIES = ("always", "hourly", "daily", "weekly", "monthly", "yearly", "never")
AVAILABILITY = ("InStock", "SoldOut", "PreOrder", "Discontinued", "LimitedAvailability")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
#: Entry pages, their names and addresses.
SECTIONS = {"open": ("可報名", "/open.html"), "topics": ("主題", "/topics.html"), "learn": ("想學什麼", "/learn.html"), "types": ("類型", "/types.html"), "cities": ("縣市", "/cities.html"), "map": ("地圖", "/map.html"), "teachers": ("講師", "/teachers.html"), "search": ("搜尋", "/search.html")}


def topics(df: DataFrame, category: str, known: DataFrame, name: str, order: str, open_flag: Column, inferred: Column) -> DataFrame:
    """(name, ord, n, n_open, n_inferred) of the categories that occur, in the known order.

    A category that is not known is an error, since its listings would vanish unseen.
    """
    counts = df.where(F.coalesce(F.col(category) != "", F.lit(False))).groupBy(F.col(category).alias(name)).agg(F.count(F.lit(1)).alias("n"), F.count_if(open_flag).alias("n_open"), F.count_if(inferred).alias("n_inferred"))
    found = cut(counts.join(known.select(name, F.col(order).alias("ord")), name, "left"), "topics")
    if unknown := [r[name] for r in found.where("ord is null").select(name).orderBy(name).limit(5).collect()]:
        raise ValueError(f"unknown categories: {unknown}")
    return found.select(name, "ord", "n", "n_open", "n_inferred")


def college_hubs(df: DataFrame, provider: str, city: str, current: Column, open_flag: Column) -> DataFrame:
    """(name, city, n, n_current, n_open): colleges under one name however sources write it.

    A college's city is the one its name begins with, or else the most frequent of its
    listings; one written without any joins the only college of its name, if there is one.
    Of several spellings the most frequent is shown, of those the longest; a name that two
    cities share has its city in front.
    """
    county = "^([臺台][北中南東]|新北|桃園|新竹|苗栗|彰化|南投|雲林|嘉義|屏東|宜蘭|花蓮|高雄|基隆|澎湖|金門|連江)[縣市]"
    rows = df.where(F.coalesce(F.col(provider) != "", F.lit(False))).select(F.col(provider).alias("raw"), F.nullif(F.col(city), F.lit("")).alias("city"), current.cast("long").alias("c"), open_flag.cast("long").alias("o"))
    by_city = rows.groupBy("raw", "city").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("c"), F.sum("o").alias("o"))
    raws = by_city.groupBy("raw").agg(F.sum("k").alias("n"), F.sum("c").alias("c"), F.sum("o").alias("o"), F.max_by("city", F.when(F.col("city").isNotNull(), F.struct("k", "city"))).alias("usual"))
    whole = F.regexp_replace(F.regexp_replace("raw", "社大$", "社區大學"), "^台", "臺")
    front = F.regexp_extract(whole, county, 0)
    rest = F.substring(whole, F.length(front) + 1, F.length(whole))
    raws = raws.select("*", F.when((front != "") & (rest != "社區大學"), rest).otherwise(whole).alias("name"), F.coalesce(F.nullif(front, F.lit("")), "usual").alias("at"))
    raws = cut(raws.withColumn("key", F.regexp_replace("name", r"^(\S{2})[縣市]社區大學$", "$1社區大學")), "colleges")
    placed = raws.where("at is not null")
    only = placed.groupBy("key").agg(F.min("at").alias("at"), F.count_distinct("at").alias("cities")).where("cities = 1").select("key", "at")
    found = placed.unionByName(raws.where("at is null").drop("at").join(only, "key").select(*raws.columns))
    best = F.struct("n", F.length("name").alias("l"), "name")
    hubs = found.groupBy("at", "key").agg(F.max_by("name", best).alias("name"), F.sum("n").alias("n"), F.sum("c").alias("n_current"), F.sum("o").alias("n_open"))
    twice = F.count(F.lit(1)).over(W.partitionBy("name")) > 1
    return hubs.select(F.when(twice, F.concat("at", "name")).otherwise(F.col("name")).alias("name"), F.col("at").alias("city"), "n", "n_current", "n_open")


MAIN_SHARE = 0.6


def main_venues(df: DataFrame, college: str, venue: str, current: Column, indexed: DataFrame, share: float = MAIN_SHARE) -> DataFrame:
    """(college, venue, n, share): the venue where a college teaches most, if most of what it shows is the college's.

    Current listings count, or all of them where none is current and placed; of equals the
    smaller venue.  ``share`` is the college's part of all the venue's listings; a venue
    below it, or not among ``indexed`` (venue), is nobody's main one, so no venue is the
    main one of two colleges.
    """
    rows = df.where(F.col(venue).isNotNull()).select(F.col(college).alias("college"), F.col(venue).alias("venue"), F.coalesce(current, F.lit(False)).cast("long").alias("now"))
    counts = rows.groupBy("college", "venue").agg(F.sum("now").alias("now"), F.count(F.lit(1)).alias("n"))
    size = counts.groupBy("venue").agg(F.sum("n").alias("of"))
    named = counts.where("college is not null")
    best = named.groupBy("college").agg(F.max("now").alias("top_now"), F.max("n").alias("top_n"))
    first = named.join(best, "college").where(F.when(F.col("top_now") > 0, F.col("now") == F.col("top_now")).otherwise(F.col("n") == F.col("top_n")))
    first = first.groupBy("college").agg(F.min_by(F.struct("venue", "n"), "venue").alias("v")).select("college", "v.venue", "v.n")
    out = first.join(size, "venue").withColumn("share", F.col("n") / F.col("of")).where(F.col("share") >= share)
    return out.join(indexed.select("venue").distinct(), "venue", "left_semi").select("college", "venue", "n", "share")


def crumbs(section: str | None, *levels: tuple[Column, Column | None]) -> Column:
    """Array of (name, href) from the home page down; levels without a name are left out, the last has no address."""
    item = lambda n, h: F.struct(n.alias("name"), h.alias("href"))
    none = F.lit(None).cast("string")
    start = [item(F.lit("首頁"), F.lit("/"))]
    if section:
        start.append(item(F.lit(SECTIONS[section][0]), F.lit(SECTIONS[section][1])))
    rest = [F.when(F.coalesce(n != "", F.lit(False)), item(n, none if h is None or k == len(levels) - 1 else h)) for k, (n, h) in enumerate(levels)]
    return F.array_compact(F.array(*start, *rest))


def sitemap_problems(entries: DataFrame, pages: DataFrame, site: str, most: int = 20_000) -> DataFrame:
    """(loc, problem) of sitemap entries (file, loc, lastmod, changefreq, priority) against pages (path, indexed).

    Addresses have to be absolute, encoded once and unique, lead to a page and not to
    one that asks not to be indexed; dates, frequencies and priorities have to be well
    formed, files not too long; every page that may be indexed has to be listed.
    """
    path = F.substring("loc", len(site) + 2, 1_000_000)
    rel = F.try_url_decode(F.regexp_replace(path, r"\+", "%2B"))
    e = entries.withColumn("inside", F.coalesce(F.col("loc").startswith(site + "/"), F.lit(False))).withColumn("rel", F.when(F.col("inside"), rel))
    e = e.withColumn("times", F.count(F.lit(1)).over(W.partitionBy("loc"))).join(pages.select(F.col("path").alias("rel"), "indexed"), "rel", "left")
    bad = lambda name, when: F.when(F.coalesce(when, F.lit(False)), F.lit(name))
    found = F.array_compact(
        F.array(
            bad("no address", F.col("loc").isNull()),
            bad("not of this site", F.col("loc").isNotNull() & ~F.col("inside")),
            bad("wrong encoding", F.col("inside") & ~F.concat(F.lit(site + "/"), encode_path(F.col("rel"))).eqNullSafe(F.col("loc"))),
            bad("repeated", F.col("loc").isNotNull() & (F.col("times") > 1)),
            bad("no such page", F.col("inside") & F.col("indexed").isNull()),
            bad("not to be indexed", ~F.col("indexed")),
            bad("date", ~F.col("lastmod").rlike(r"^\d{4}-\d{2}-\d{2}$")),
            bad("frequency", ~F.col("changefreq").isin(*FREQUENCIES)),
            bad("priority", ~F.coalesce(F.col("priority").try_cast("double").between(0, 1), F.lit(False)) & F.col("priority").isNotNull()),
        )
    )
    rows = e.select("loc", F.explode(found).alias("problem")).distinct()
    long = entries.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col("file").cast("string").alias("loc"), F.lit("file too long").alias("problem"))
    missing = pages.where("indexed").join(e.select(F.col("rel").alias("path")).distinct(), "path", "left_anti").select(xml_escape(F.col("path")).alias("loc"), F.lit("page not listed").alias("problem"))
    return rows.unionByName(long).unionByName(missing)


#: What course documents hold, as far as it is checked; a price keeps the type it is written with.
_OFFER = "struct<availability:string,price:variant,priceCurrency:string>"
COURSE_LD = (
    f"description string, provider struct<name:string>, offers {_OFFER}, "
    f"hasCourseInstance struct<offers:{_OFFER},courseSchedule:struct<byDay:array<string>,startDate:string,repeatFrequency:string>,location:struct<geo:struct<latitude:double,longitude:double>>>"
)


def course_ld_problems(documents: DataFrame, id_col: str, json: str) -> DataFrame:
    """(id, problem) of course documents: lengths, required names, enumerations, prices, dates, coordinates.

    Both the course's offer and its instance's are checked; a price written as text is no
    number.  A problem that a document has twice is named once.
    """
    d = documents.select(id_col, F.from_json(json, COURSE_LD).alias("d"))
    s, geo = F.col("d.hasCourseInstance.courseSchedule"), F.col("d.hasCourseInstance.location.geo")
    bad = lambda name, when: F.when(F.coalesce(when, F.lit(False)), F.lit(name))
    url = lambda names: [f"https://schema.org/{n}" for n in names]

    def offer(o: Column) -> list[Column]:
        numeric = F.schema_of_variant(o["price"]).rlike("(?i)^(bigint|tinyint|smallint|int|decimal|double|float)")
        return [
            bad("availability", ~o["availability"].isin(*url(AVAILABILITY))),
            bad("price is no number", o["price"].isNotNull() & ~numeric),
            bad("price without currency", o["price"].isNotNull() & (F.coalesce(o["priceCurrency"], F.lit("")) == "")),
        ]

    found = F.array_distinct(F.array_compact(
        F.array(
            bad("long description", F.length("d.description") > 300),
            bad("no provider", F.col("d.provider").isNull()),
            bad("provider without a name", F.col("d.provider").isNotNull() & (F.coalesce("d.provider.name", F.lit("")) == "")),
            *offer(F.col("d.offers")),
            *offer(F.col("d.hasCourseInstance.offers")),
            bad("day", F.exists(s["byDay"], lambda x: ~x.isin(*url(DAYS)))),
            bad("start date", ~s["startDate"].rlike(r"^\d{4}-\d{2}-\d{2}")),
            bad("frequency", ~s["repeatFrequency"].startswith("P")),
            bad("coordinates", ~(geo["latitude"].between(20, 27) & geo["longitude"].between(118, 123))),
        )
    ))
    return d.select(id_col, F.explode(found).alias("problem"))


def crumb_ld_problems(items: DataFrame, list_col: str) -> DataFrame:
    """(list, problem) of breadcrumbs (list, position): positions run from 1 without gaps or repeats."""
    g = items.groupBy(list_col).agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.count_distinct("position").alias("places"))
    wrong = (F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("places") != F.col("n"))
    return g.where(F.coalesce(wrong, F.lit(True))).select(list_col, F.lit("positions").alias("problem"))


def list_ld_problems(items: DataFrame, list_col: str, least: int = 3) -> DataFrame:
    """(list, problem) of item lists (list, position, url): length, gaps, missing and repeated addresses."""
    g = items.groupBy(list_col).agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.count_distinct("position").alias("places"), F.count_if(F.coalesce(F.col("url"), F.lit("")) == "").alias("blank"), F.count_distinct("url").alias("urls"), F.count("url").alias("with_url"))
    bad = lambda name, when: F.when(when, F.lit(name))
    found = F.array_compact(F.array(bad("too short", F.col("n") < least), bad("positions", (F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("places") != F.col("n"))), bad("no address", F.col("blank") > 0), bad("repeated address", F.col("urls") < F.col("with_url"))))
    return g.select(list_col, F.explode(found).alias("problem"))
