"""Mappings of libraries, event calendars, timetables and on-the-job training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_taiwan
from ..functions.text import decode_entities, encode_uri_component, squash, trim_all
from ..operators import windows as Wn
from ..operators.rules import classify
from .normalize import COUNTIES, HOUSE_NUMBER, _ordered, _term, _window, course, group, no_zip, number, slot, teacher, text, venue
from .portals import blank

#: Status words of library calendars, in the order they are tried.
NATIONAL_STATUS = [("額滿", "full"), ("尚未開始|即將開始", "upcoming"), ("報名中|開放報名", "open"), ("截止|結束", "closed"), ("取消|停辦|停止", "cancelled")]
CITY_STATUS = [("額滿", "full"), ("尚未開始", "upcoming"), ("開放報名|報名中", "open"), ("截止|結束", "closed"), ("取消|停辦", "cancelled")]
#: Other names of branches.
NEW_CITY_ALIAS = {"總館": "新北市立圖書館"}
TAINAN_ALIAS = {"市圖總館(新總館)": "臺南市立圖書館(新總館)", "市圖總館(公園總館)": "臺南市立圖書館(公園總館)", "台江文化中心圖書館": "臺南市臺江文化中心圖書館"}
NO_BRANCH = "^(全市|跨館|其他)"


def clean(c: str | Column) -> Column:
    """Text with every run of white space as one space; blank becomes null."""
    return F.nullif(squash(F.coalesce(text(c), F.lit(""))), F.lit(""))


def no_slots() -> Column:
    return F.array().cast("array<struct<weekday:int,startTime:string,endTime:string>>")


def moment(date: Column, s: Column, pattern: str = r"([0-9]{1,2}):([0-9]{2})") -> Column:
    """A date with the first clock time of ``s``, in local time."""
    return F.concat(date, F.lit("T"), F.lpad(group(s, pattern, 1), 2, "0"), F.lit(":"), group(s, pattern, 2), F.lit(":00+08:00"))


def checked_date(year: Column, month: Column, day: Column) -> Column:
    ok = month.try_cast("int").between(1, 12) & day.try_cast("int").between(1, 31)
    return F.when(ok, F.concat_ws("-", year.cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def slashed(s: Column) -> Column:
    p = r"(\d{4})/(\d{1,2})/(\d{1,2})"
    return F.when(s.rlike(p), checked_date(group(s, p, 1), group(s, p, 2), group(s, p, 3)))


def roc_slashed(s: Column) -> Column:
    """A date in years since 1911."""
    p = r"(\d{3})[-/](\d{1,2})/(\d{1,2})"
    return F.when(s.rlike(p), checked_date(group(s, p, 1).try_cast("int") + 1911, group(s, p, 2), group(s, p, 3)))


def piece(s: Column, pattern: str, n: int) -> Column:
    return F.get(F.split(F.coalesce(s, F.lit("")), pattern), F.lit(n))


def branches_of(libraries: DataFrame, county: str) -> DataFrame:
    """One county's libraries in the register's order (ord, b_name, b_address, b_area, b_lat, b_lng)."""
    rows = libraries.where(text("縣市") == county).select(F.posexplode("圖書館資訊").alias("ord", "l"))
    return rows.select("ord", text(F.col("l.Name")).alias("b_name"), clean(F.col("l.Address")).alias("b_address"), clean(F.col("l.Area")).alias("b_area"), F.col("l.Latitude").try_cast("double").alias("b_lat"), F.col("l.Longitude").try_cast("double").alias("b_lng")).where("b_name is not null")


def _renamed(name: Column, alias: dict[str, str]) -> Column:
    out = name
    for k, v in alias.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def _at_branch(venue_name: Column, otherwise: Column, city: str, plain_city: Column | None = None) -> dict[str, Column]:
    """Where an event is: at a register's branch, or only by name."""
    found, both = F.col("b_name").isNotNull(), F.col("b_lat").isNotNull() & F.col("b_lng").isNotNull()
    return {
        "location.venueNameRaw": F.when(found, venue_name).otherwise(otherwise), "location.address": F.col("b_address"), "location.district": F.col("b_area"),
        "location.city": F.when(found, city).otherwise(F.lit(None) if plain_city is None else plain_city),
        "location.addressPrecision": F.when(F.col("b_address").isNotNull(), "street").when(found | otherwise.isNotNull(), "venue-name-only").otherwise("none"),
        "location.lat": F.when(both, F.col("b_lat")), "location.lng": F.when(both, F.col("b_lng")), "location.geocodeSource": F.when(both, "registry"),
    }


def timetable_images(raw: DataFrame, centers: DataFrame, fetched_at: str, order: str | None = None) -> DataFrame:
    """Rows read from timetable pictures, first of each code, month and centre; centers (_center, name, address, operator)."""
    raw, at = _ordered(raw, order)
    df = raw.join(centers.select("_center", F.col("name").alias("c_name"), F.col("address").alias("c_address"), F.col("operator").alias("c_operator")), "_center")
    df = df.where(text("title").isNotNull() & F.col("weekdays").isNotNull() & text("startTime").isNotNull())
    month = F.coalesce(F.substring(text("startDate"), 1, 7), text("_periodStartMonth"))
    key = F.coalesce(text("code"), F.concat_ws("|", text("title"), F.array_join(F.col("weekdays").cast("array<string>"), ""), text("startTime")))
    df = df.withColumn("k", F.concat_ws(":", "_center", F.coalesce(month, F.col("_docKey").cast("string")), key)).withColumn("m", month)
    one = Wn.keep_first(df, ["k"], [F.col(at)])
    district, sessions, price, who = group(F.col("c_address"), "^新北市(.{1,3}?區)"), F.col("sessions").try_cast("int"), F.col("price").try_cast("int"), text("teacher")
    extra = F.concat_ws("；", F.when(sessions > 0, F.concat(F.lit("共 "), sessions.cast("string"), F.lit(" 堂"))), text("note"))
    return course(one, "center-timetable-images", F.col("k"), fetched_at, {
        "title": text("title"), "provider.nameRaw": F.col("c_name"), "provider.kind": F.lit("sports-center"), "provider.operatorRaw": F.col("c_operator"),
        "schedule.startDate": text("startDate"), "schedule.endDate": text("endDate"), "schedule.recurrence": F.lit("weekly"), "schedule.slots": F.transform("weekdays", lambda d: slot(d, text("startTime"), text("endTime"))), "schedule.timeInfoRaw": F.nullif(extra, F.lit("")),
        "enrollment.status": F.lit("unknown"), "externalIds.centerCourseCode": text("code"), "categoryRaw": F.coalesce(text("category"), text("section")), "audienceRaw": text("audience"), "teachers": teacher(F.when(~who.rlike("師資|團隊|教練群|協調"), who)),
        "isFree": F.when(price == 0, True), "price": F.when(price != 0, price), "priceText": F.concat(price.cast("string"), F.lit(" 元"), F.coalesce(F.when(sessions > 0, F.concat(F.lit("／"), sessions.cast("string"), F.lit(" 堂"))), F.lit(""))),
        "location.venueNameRaw": trim_all(F.concat_ws(" ", F.col("c_name"), text("place"))), "location.city": F.lit("新北市"), "location.district": district, "location.addressPrecision": F.when(district.isNotNull(), "district").otherwise("city"),
        "sourceUrl": text("_docUrl"), **{c: F.when(F.col("m").rlike(r"^\d{4}-\d{2}"), v) for c, v in _term(F.concat(F.substring(F.col("m"), 1, 7), F.lit("-01"))).items()},
    })


def new_city_libraries(raw: DataFrame, libraries: DataFrame, fetched_at: str) -> DataFrame:
    """Library events whose title names a branch, exactly or by the end of its name."""
    home = "新北市立圖書館"
    df = raw.withColumns({"a": clean("activityTitle"), "s": clean("sessionTitle"), "d": clean("activityDateText")}).where("a is not null").withColumn("prefix", clean(group(F.col("a"), "^【([^】]+)】")))
    usable = F.when(~F.col("prefix").rlike(NO_BRANCH), trim_all(piece(F.col("prefix"), "[/、]", 0)))
    # as written, and without the sign for a district behind a short name
    tries = F.array_distinct(F.array(usable, F.regexp_replace(usable, "^([^區]{2,3})區", "$1")))
    asked = df.select("prefix").distinct().select("prefix", usable.alias("first"), F.posexplode(tries).alias("nth", "try")).where("first is not null and `try` <> ''")
    branches = branches_of(libraries, "新北市")
    full = F.when(F.col("first").isin(*NEW_CITY_ALIAS), _renamed(F.col("first"), NEW_CITY_ALIAS)).otherwise(F.concat(F.lit(home), "try"))
    exact = asked.withColumn("b", full).join(branches.withColumnRenamed("b_name", "b"), "b").select("prefix", F.col("nth"), F.lit(0).alias("how"), "ord")
    ends = branches.select("ord", F.explode(F.transform(F.sequence(F.lit(1), F.length("b_name")), lambda i: F.substr("b_name", i, F.length("b_name")))).alias("try"))
    tail = asked.where(~F.col("first").isin(*NEW_CITY_ALIAS)).join(ends, "try").select("prefix", "nth", F.lit(1).alias("how"), "ord")
    best = exact.unionByName(tail).groupBy("prefix").agg(F.min(F.struct("nth", "how", "ord")).alias("x")).select("prefix", "x.ord")
    df = df.join(best.join(branches, "ord").drop("ord"), "prefix", "left")
    named = F.concat(F.lit(home), "prefix")
    quota, said, url = r"^(\d+)\s*/\s*(\d+)$", clean("stateText"), clean("url")
    cap = group(text("quotaText"), quota, 2).try_cast("int")
    free = F.greatest(cap - group(text("quotaText"), quota, 1).try_cast("int"), F.lit(0))
    day = group(F.col("d"), r"(\d{4}-\d{2}-\d{2})")
    at = lambda c: moment(group(text(c), r"(\d{4}-\d{2}-\d{2})"), text(c), r"\d{4}-\d{2}-\d{2}\s+(\d{1,2}):(\d{2})")
    record = F.coalesce(text("sessionId"), F.substring(F.sha1(F.concat_ws("|", "a", F.coalesce("s", F.lit("")), F.coalesce("d", F.lit("")))), 1, 16))
    plain = F.when(~F.col("prefix").rlike(NO_BRANCH), named)
    return course(df, "ntpc-library-activities", record, fetched_at, {
        "title": F.when(F.col("s").isNotNull() & (F.col("s") != F.col("a")), F.concat("a", F.lit("－"), "s")).otherwise(F.col("a")), "provider.nameRaw": F.coalesce(F.col("b_name"), named, F.lit(home)), "provider.kind": F.lit("library"),
        "schedule.recurrence": F.lit("single"), "schedule.slots": no_slots(), "schedule.startDate": day, "schedule.endDate": day, "schedule.timeInfoRaw": F.col("d"),
        "enrollment.capacity": cap, "enrollment.available": F.when(cap.isNotNull(), free), "enrollment.statusRaw": said, "enrollment.status": F.when(said.rlike("額滿"), "full").when(said.rlike("報名"), "open").when(F.when(cap.isNotNull(), free) == 0, "full").otherwise("unknown"),
        "enrollment.opensAt": at("registerStartText"), "enrollment.closesAt": at("registerEndText"), "enrollment.registerUrl": url, "sourceUrl": url, "description": clean("excerptText"),
        **_at_branch(F.col("b_name"), plain, "新北市", F.when(plain.isNotNull(), "新北市")),
    })


def national_library_events(raw: DataFrame, fetched_at: str) -> DataFrame:
    """Events with a list of sessions: one session has free places, several have none; dates since 1911."""
    tidy = lambda c: text(decode_entities(F.coalesce(text(c), F.lit(""))))
    ranges = lambda c, n: piece(text(c), "~", n)
    start = roc_slashed(ranges("listActivityRangeText", 0))
    end = F.coalesce(roc_slashed(ranges("listActivityRangeText", 1)), start)
    none = F.array().cast("array<struct<remainingText:string,venueText:string>>")
    sessions = F.coalesce(F.transform("sessions", lambda s: F.struct(s["remainingText"].cast("string").alias("remainingText"), s["venueText"].cast("string").alias("venueText"))), none)
    n, left = F.size(sessions), trim_all(F.get(sessions, F.lit(0))["remainingText"])
    venues = F.array_distinct(F.filter(F.transform(sessions, lambda s: F.nullif(trim_all(s["venueText"]), F.lit(""))), lambda v: v.isNotNull()))
    said, url, at = tidy("statusText"), tidy("url"), lambda s: moment(roc_slashed(s), s)
    return course(raw.where(text("activityId").isNotNull() & text("title").isNotNull()), "nlpi-activities", text("activityId"), fetched_at, {
        "title": tidy("title"), "provider.nameRaw": F.lit("國立公共資訊圖書館"), "provider.kind": F.lit("library"), "schedule.recurrence": F.when(n > 1, "irregular").otherwise("single"), "schedule.slots": no_slots(),
        "schedule.startDate": start, "schedule.endDate": end, "schedule.timeInfoRaw": tidy("activityTimeText"), "schedule.sessions": F.when(n > 1, n),
        "enrollment.status": F.coalesce(classify(said, NATIONAL_STATUS), F.lit("unknown")), "enrollment.statusRaw": said, "enrollment.opensAt": at(ranges("registerTimeText", 0)), "enrollment.closesAt": at(ranges("registerTimeText", 1)),
        "enrollment.available": F.when((n == 1) & left.rlike("^[0-9]+$"), left), "enrollment.registerUrl": url, "sourceUrl": url, "categoryRaw": tidy("categoryText"), "audienceRaw": tidy("audienceText"), "description": tidy("introText"),
        "location.venueNameRaw": F.when(F.size(venues) == 1, F.concat(F.lit("國立公共資訊圖書館"), F.get(venues, F.lit(0)))).when(F.size(venues) > 1, F.array_join(venues, "、")), "location.addressPrecision": F.when(F.size(venues) == 1, "venue-name-only").otherwise("none"),
    })


def markup_text(c: Column) -> Column:
    """Text of markup that keeps its lines; blank becomes null."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)<br\s*/?>", "\n"), r"(?i)</(p|div|li)>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(value))
    return text(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def tainan_library_events(raw: DataFrame, libraries: DataFrame, fetched_at: str) -> DataFrame:
    """Activities whose sessions become rows of their own; the organiser is found in the register."""
    df = raw.withColumns({"url": clean("主活動資訊網址暨報名連結"), "a": clean("主活動名稱"), "host": clean("主辦單位")}).withColumn("activity", group(F.col("url"), "/(z[a-z0-9]+)/"))
    df = df.where("activity is not null and a is not null").select("*", F.posexplode("本活動內各場次資訊").alias("i", "x"))
    branches = branches_of(libraries, "臺南市")
    hosts = df.select("host").where("host is not null").distinct().withColumn("target", _renamed(F.col("host"), TAINAN_ALIAS))
    ends = branches.select("b_name", "ord", F.explode(F.transform(F.sequence(F.lit(1), F.length("b_name")), lambda i: F.substr("b_name", i, F.length("b_name")))).alias("target"))
    best = hosts.join(ends, "target").groupBy("host").agg(F.min(F.struct(F.when(F.col("b_name") == F.col("target"), 0).otherwise(1).alias("how"), F.col("ord"))).alias("y")).select("host", "y.ord")
    df = df.join(best.join(branches, "ord").drop("ord"), "host", "left")
    x = lambda name: clean(F.col("x")[name].cast("string"))
    ranges = lambda name, n: piece(x(name), r"\s*至\s*", n)
    start = slashed(ranges("活動時間", 0))
    end, said, fee = F.coalesce(slashed(ranges("活動時間", 1)), start), x("報名狀態"), x("是否收費")
    at = lambda s: moment(slashed(s), s)
    name = F.nullif(F.concat_ws(" ", "host", x("活動地點")), F.lit(""))
    return course(df, "tnpl-activities", F.concat_ws("#", "activity", F.col("i").cast("string")), fetched_at, {
        "title": F.when(x("場次名稱").isNotNull() & (x("場次名稱") != F.col("a")), F.concat("a", F.lit("－"), x("場次名稱"))).otherwise(F.col("a")), "provider.nameRaw": F.coalesce("host", F.lit("臺南市立圖書館")), "provider.kind": F.lit("library"),
        "schedule.recurrence": F.when(end != start, "irregular").otherwise("single"), "schedule.slots": no_slots(), "schedule.startDate": start, "schedule.endDate": end, "schedule.timeInfoRaw": x("活動時間"),
        "enrollment.status": F.coalesce(classify(said, CITY_STATUS), F.lit("unknown")), "enrollment.statusRaw": said, "enrollment.opensAt": at(ranges("報名時間", 0)), "enrollment.closesAt": at(ranges("報名時間", 1)), "enrollment.capacity": F.when(x("可報名數").rlike("^[0-9]+$"), x("可報名數")), "enrollment.registerUrl": F.col("url"),
        "sourceUrl": F.col("url"), "categoryRaw": clean("主活動主題"), "audienceRaw": F.nullif(F.concat_ws("；", clean("主活動對象"), x("年齡限制")), F.lit("")), "teachers": teacher(x("講師姓名")),
        "description": F.nullif(F.concat_ws("\n\n", markup_text(F.col("x")["活動說明"]), markup_text(F.col("主活動主要說明"))), F.lit("")), "isFree": F.when(fee == "否", True).when(fee == "是", False),
        **_at_branch(F.coalesce(name, F.col("b_name")), name, "臺南市"),
    })


def library_calendar(raw: DataFrame, fetched_at: str, place: dict[str, str] | None = None) -> DataFrame:
    """A calendar feed; a place that its text names with a full address overrides the default one."""
    place = place or {}
    given = lambda k: F.lit(place.get(k)).cast("string")
    link, info, end = text("link"), text("description"), group(text("enddate"), r"^(\d{4}-\d{2}-\d{2})$")
    stated = r"地點[：:]\s*([^（(]{2,60})[（(]([^）)]{6,80})[）)]"
    address = trim_all(F.regexp_extract(F.coalesce(info, F.lit("")), stated, 2))
    city = group(address, "^(" + "|".join([*COUNTIES, "台北市", "台中市", "台南市", "台東縣"]) + ")")
    ok = city.isNotNull() & address.rlike(HOUSE_NUMBER)
    district = group(F.substring(address, F.length(city) + 1, F.length(address)), "^([^0-9]{1,4}?[區鄉鎮市])")
    pick = lambda mine, key: F.when(ok, mine).otherwise(given(key))
    return course(raw.where(link.isNotNull() & text("title").isNotNull()), "ncl-events", F.coalesce(group(link, r"SId=([\w-]+)"), link), fetched_at, {
        "title": text("title"), "provider.nameRaw": F.coalesce(given("name"), F.lit("國家圖書館")), "provider.kind": F.lit("library"), "schedule.startDate": group(text("startdate"), r"^(\d{4}-\d{2}-\d{2})$"), "schedule.endDate": end, "schedule.slots": no_slots(),
        "enrollment.status": F.when(end < fetched_at[:10], "closed").otherwise("unknown"), "enrollment.registerUrl": link, "sourceUrl": link, "categoryRaw": text("type"), "description": info, "sourceUpdatedAt": text("a10:updated"),
        "location.venueNameRaw": pick(trim_all(F.regexp_extract(F.coalesce(info, F.lit("")), stated, 1)), "name"), "location.address": pick(address, "address"), "location.city": pick(city, "city"), "location.district": pick(district, "district"),
        "location.addressPrecision": F.when(ok | given("address").isNotNull(), "street").otherwise("venue-name-only"),
    })


def on_the_job_training(raw: DataFrame, fetched_at: str) -> DataFrame:
    """On-the-job training: eight-digit dates, the student's own share as the price, addresses built from codes."""
    ymd = lambda c: F.when(text(c).rlike("^[0-9]{8}$"), F.regexp_replace(text(c), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
    code, opens, closes, no = text("課程代碼"), ymd("報名開始日"), ymd("報名結束日"), text("期別")
    url = F.concat(F.lit("https://ojt.wda.gov.tw/ClassSearch/Detail?PlanType=2&OCID="), encode_uri_component(code))
    price = group(text("負擔費用"), r"學員負擔[：:]\s*([\d.]+)").try_cast("double")
    body = F.filter(F.transform(F.split(F.replace(blank("課程內容"), F.lit("&amp;"), F.lit("&")), r"\^"), lambda x: trim_all(F.regexp_replace(x, r"[\t\r]+", " "))), lambda x: x != "")
    return course(raw.where(code.isNotNull() & text("課程名稱").isNotNull()), "mol-6614", code, fetched_at, {
        "title": text("課程名稱"), "provider.nameRaw": text("辦理單位"), "provider.kind": F.lit("vocational"), "provider.planRaw": F.lit("分署自辦在職訓練"), "schedule.startDate": ymd("開訓日期"), "schedule.endDate": ymd("結訓日期"), "schedule.recurrence": F.lit("irregular"), "schedule.slots": no_slots(),
        "schedule.hours": F.when(number("訓練時數") > 0, number("訓練時數")), "schedule.timeInfoRaw": text("訓練時段"), "enrollment.status": _window(opens, closes, fetched_at[:10]), "enrollment.opensAt": opens, "enrollment.closesAt": closes, "enrollment.registerUrl": url,
        "location.city": text("訓練地點"), "location.addressPrecision": F.lit("city"), "location.venueNameRaw": text("辦理單位"), "externalIds.taiwanjobs": code, "sourceUrl": url,
        "term.raw": no, "term.termNo": F.when(no.rlike("^0*[1-9][0-9]*$"), no), "price": price, "isFree": price == 0, "priceText": F.when(price.isNotNull(), text("負擔費用")), "description": F.nullif(F.array_join(body, "\n"), F.lit("")),
    })


def public_libraries(raw: DataFrame, fetched_at: str, order: str | None = None) -> DataFrame:
    """The register of libraries, nested by county: no test rows, the first of each name, coordinates in pairs."""
    raw, at = _ordered(raw, order)
    rows = raw.select(at, text("縣市").alias("city"), F.posexplode("圖書館資訊").alias("n", "l")).withColumn("name", text(F.col("l.Name")))
    rows = rows.where("city is not null and name is not null").where(~F.col("name").contains("測試")).withColumn("k", F.concat_ws("|", "city", "name"))
    one = Wn.keep_first(rows, ["k"], [F.col(at), F.col("n")])
    get = lambda c: text(F.col(f"l.{c}").cast("string"))
    lat, lng = get("Latitude").try_cast("double"), get("Longitude").try_cast("double")
    ok = in_taiwan(lat, lng)
    return venue(one, "national-public-libraries", F.col("k"), fetched_at, {
        "name": F.col("name"), "kindRaw": F.lit("公共圖書館"), "city": F.col("city"), "district": get("Area"), "address": no_zip(get("Address")), "lat": F.when(ok, lat), "lng": F.when(ok, lng), "phone": get("TEL"), "website": get("URL"),
        "description": clean(decode_entities(F.regexp_replace(F.coalesce(get("Intro"), F.lit("")), "<[^>]*>", " "))),
    })


NORMALIZERS: dict[str, Callable[..., DataFrame]] = {
    "center-timetable-images": timetable_images,
    "ntpc-library-activities": new_city_libraries,
    "nlpi-activities": national_library_events,
    "tnpl-activities": tainan_library_events,
    "ncl-events": library_calendar,
    "mol-6614": on_the_job_training,
    "national-public-libraries": public_libraries,
}
