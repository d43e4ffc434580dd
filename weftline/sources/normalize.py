"""Raw records to listing rows: one declarative mapping for each source.

A mapping names columns by their path in the listing schema; what it leaves out
is null.  Blank text is missing, never a value, and a blank price is unknown,
not free.  ``fetched_at`` is an ISO time; its date is "today" for statuses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..functions.geo import in_taiwan
from ..functions.text import tai, trim_all
from ..operators import windows as Wn
from ..operators.rules import code_map
from ..schema import COURSE, VENUE

#: Weekday characters and the counties.
WEEKDAYS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "日": 7}
COUNTIES = (
    "臺北市 新北市 桃園市 臺中市 臺南市 高雄市 基隆市 新竹市 嘉義市 新竹縣 苗栗縣 彰化縣 南投縣 雲林縣 嘉義縣 屏東縣 宜蘭縣 花蓮縣 臺東縣 澎湖縣 金門縣 連江縣"
).split()
#: County codes of the sports venue register.
COUNTY_CODES = {
    "63000": "臺北市", "65000": "新北市", "68000": "桃園市", "66000": "臺中市", "67000": "臺南市", "64000": "高雄市",
    "10017": "基隆市", "10018": "新竹市", "10020": "嘉義市", "10004": "新竹縣", "10005": "苗栗縣", "10007": "彰化縣",
    "10008": "南投縣", "10009": "雲林縣", "10010": "嘉義縣", "10013": "屏東縣", "10002": "宜蘭縣", "10015": "花蓮縣",
    "10014": "臺東縣", "10016": "澎湖縣", "9020": "金門縣", "9007": "連江縣",
}
#: Codes of the national college listing.
COLLEGE_RECURRENCE = {"11": "weekly", "12": "twice-weekly", "21": "biweekly", "22": "biweekly-twice", "99": "irregular"}
COLLEGE_SEASONS = {"1": "spring", "2": "autumn", "3": "summer", "4": "winter"}
COLLEGE_TOPICS = dict(enumerate((
    "性別平等 公民素養 人權法治 環境永續 媒體素養 安全教育 生命教育 社區總體營造 新住民課程 國防教育 本土語文 山野教育 美感教育 傳統藝術 "
    "民俗文化資產 消費者保護 家庭教育 地方學 用藥安全 其他 英語教育 非上述屬性 科技學習 代間學習 高齡心理健康 交通安全"
).split(), 1))
#: Enrolment codes of the seat listing.
SEAT_STATUS = {"0": ("open", "我要報名"), "1": ("upcoming", "報名時間未到"), "2": ("closed", "報名時間已過"), "3": ("running", "課程已開始"), "4": ("unknown", "目前僅限原班學員續報")}

HOUSE_NUMBER = r"[0-9]+\s*號"


def text(c: str | Column) -> Column:
    """Trimmed text; blank becomes null."""
    col = F.col(f"`{c}`") if isinstance(c, str) else c
    return F.nullif(trim_all(col.cast("string")), F.lit(""))


def number(c: str | Column) -> Column:
    return text(c).try_cast("double")


def county_of(s: Column) -> Column:
    """The county that a text starts with."""
    return F.nullif(F.regexp_extract(tai(F.coalesce(s, F.lit(""))), "^(" + "|".join(COUNTIES) + ")", 1), F.lit(""))


def no_zip(s: Column) -> Column:
    return text(F.regexp_replace(s, r"^(\[\d+\]|\d{3,6})", ""))


def group(s: Column, pattern: str, n: int = 1) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(s, F.lit("")), pattern, n), F.lit(""))


def slot(weekday: Column, start: Column | None = None, end: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(weekday.cast("int").alias("weekday"), (none if start is None else start).alias("startTime"), (none if end is None else end).alias("endTime"))


def teacher(name: Column) -> Column:
    return F.when(name.isNotNull(), F.array(F.struct(name.alias("nameRaw"))))


def shaped(df: DataFrame, schema: str, values: dict[str, Column]) -> DataFrame:
    """Rows of a schema from columns named by path, as in ``schedule.startDate``."""
    kind = df.sparkSession.createDataFrame([], schema).schema
    used = set()

    def make(field: T.StructField, path: str) -> Column:
        if path in values:
            used.add(path)
            return values[path].cast(field.dataType).alias(field.name)
        inner = [p for p in values if p.startswith(path + ".")]
        if isinstance(field.dataType, T.StructType) and inner:
            return F.struct(*[make(f, f"{path}.{f.name}") for f in field.dataType.fields]).alias(field.name)
        return F.lit(None).cast(field.dataType).alias(field.name)

    out = df.select(*[make(f, f.name) for f in kind.fields])
    if unknown := set(values) - used:
        raise ValueError(f"not in the schema: {sorted(unknown)}")
    return out


def course(df: DataFrame, source: str, record: Column, fetched_at: str, values: dict[str, Column]) -> DataFrame:
    return shaped(df, COURSE, {"_source": F.lit(source), "_sourceRecordId": record, "_fetchedAt": F.lit(fetched_at), **values})


def venue(df: DataFrame, source: str, record: Column, fetched_at: str, values: dict[str, Column]) -> DataFrame:
    return shaped(df, VENUE, {"_source": F.lit(source), "_sourceRecordId": record, "_fetchedAt": F.lit(fetched_at), **values})


def _term(date: Column) -> dict[str, Column]:
    """Two-month term of a start date, in years since 1911."""
    d = F.to_date(date)
    year, no = F.year(d) - 1911, (F.floor((F.month(d) - 1) / 2) + 1).cast("int")
    return {"term.raw": F.concat(year.cast("string"), F.lpad(no.cast("string"), 2, "0")), "term.year": year, "term.termNo": no}


def _seats(available: Column) -> Column:
    return F.when(available == 0, "full").when(available > 0, "open").otherwise("unknown")


def _window(opens: Column, closes: Column, today: str) -> Column:
    """Status from both ends of the enrolment period; one end alone does not open it."""
    return F.when(closes < today, "closed").when(opens > today, "upcoming").when(opens.isNotNull() & closes.isNotNull(), "open").otherwise("unknown")


def college_values() -> dict[str, Column]:
    """What listing and detail records of the national colleges share."""
    clock = lambda c: F.when(text(c) != "00:00:00", F.substring(text(c), 1, 5))
    day = lambda c: F.when(number(c) == 0, 7).otherwise(number(c))
    date = lambda c: F.when(text(c) != "0000-00-00", text(c))
    address, price, quarter, cat = text("address"), number("price"), text("quarter"), text("time_cat_id")
    one, two = slot(day("weekday"), clock("time_begin"), clock("time_end")), slot(day("weekday_2"), clock("time_2_begin"), clock("time_2_end"))
    slots = F.array(F.when(one["startTime"].isNotNull() | one["weekday"].isNotNull(), one), F.when(cat.endswith("2") & two["startTime"].isNotNull(), two))
    topics = F.transform(F.split(F.coalesce(text("course_tag_id_arr"), F.lit("")), ";"), lambda x: code_map(x.try_cast("int"), COLLEGE_TOPICS))
    numbered = address.rlike(HOUSE_NUMBER)
    year = F.when(F.length(quarter) == 4, F.substring(quarter, 1, 3).try_cast("int"))
    return {
        "title": text("course_name"), "provider.nameRaw": text("school_name"), "provider.kind": F.lit("community-college"),
        "schedule.recurrence": F.coalesce(code_map(cat, COLLEGE_RECURRENCE), F.lit("irregular")), "schedule.slots": F.array_compact(slots),
        "schedule.startDate": date("date_begin"), "schedule.endDate": date("date_end"), "schedule.timeInfoRaw": text("time_info"),
        "enrollment.status": F.lit("unknown"), "enrollment.statusRaw": F.when(text("teach_status") == "1", "正常開課").otherwise(text("teach_status")),
        "location.venueNameRaw": address, "location.address": F.when(numbered, address),
        "location.addressPrecision": F.when(address.isNull(), "none").when(numbered, "street").otherwise("venue-name-only"),
        "term.raw": F.when(year > 0, quarter), "term.year": F.when(year > 0, year), "term.season": F.when(year > 0, code_map(F.substring(quarter, 4, 1), COLLEGE_SEASONS)),
        "teachers": teacher(text("teacher_name")), "price": price, "isFree": price == 0, "credit": F.when(number("credit") > 0, number("credit")),
        "sourceUrl": F.when(text("course_url").startswith("http"), text("course_url")), "topicsRaw": F.when(F.size(F.array_compact(topics)) > 0, F.array_compact(topics)),
    }


def college_courses(raw: DataFrame, schools: DataFrame, fetched_at: str) -> DataFrame:
    """The national college listing with its school dimension (school_id, region_name)."""
    regions = schools.select(F.col("school_id").cast("string").alias("school_id"), "region_name")
    df = raw.where(text("course_id").isNotNull()).withColumn("school_id", text("school_id")).join(regions, "school_id", "left")
    return course(df, "moe-cc-courses", text("course_id"), fetched_at, college_values() | {"location.city": F.col("region_name")})


def seat_bookings(raw: DataFrame, sites: DataFrame, fetched_at: str) -> DataFrame:
    """The booking system with free seats; sites (_site, venueName, city, district, host) are a dimension."""
    df = raw.where(text("courseCode").isNotNull() & text("_site").isNotNull()).join(sites, "_site", "left")
    name = F.coalesce(F.col("venueName"), F.col("_site"))
    weekday = code_map(text("weekday"), WEEKDAYS)
    free = number("available")
    one = slot(weekday, text("timeBegin"), text("timeEnd"))
    return course(df, "xuanen-centers", F.concat_ws(":", "_site", "courseCode"), fetched_at, {
        "title": text("courseName"), "externalIds.centerCourseCode": text("courseCode"), "categoryRaw": text("_categoryName"),
        "provider.nameRaw": name, "provider.kind": F.lit("sports-center"), "provider.operatorRaw": text("_operator"),
        "schedule.startDate": text("dateBegin"), "schedule.endDate": text("dateEnd"), "schedule.recurrence": F.lit("weekly"),
        "schedule.slots": F.array_compact(F.array(F.when(F.coalesce(weekday.cast("string"), text("timeBegin"), text("timeEnd")).isNotNull(), one))),
        "enrollment.status": _seats(free), "enrollment.capacity": number("capacity"), "enrollment.available": free,
        "location.venueNameRaw": trim_all(F.concat_ws(" ", name, text("classroom"))), "location.addressPrecision": F.lit("venue-name-only"), "location.city": F.col("city"), "location.district": F.col("district"),
        "teachers": teacher(text("teacher")), "sourceUrl": F.when(F.col("host").isNotNull(), F.concat(F.lit("https://"), "host")), **_term(text("dateBegin")),
    })


def seat_listing(raw: DataFrame, fetched_at: str) -> DataFrame:
    """The seat interface: weekday arrays, status codes that full seats override, excluded dates."""
    start, end = (F.when(F.col(c).rlike(r"^\d{2}:\d{2}"), F.substring(c, 1, 5)) for c in ("startTime", "endTime"))
    date = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10))
    local = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), F.concat(F.col(c), F.lit("+08:00")))
    code, full = F.col("enrollmentStatus").cast("string"), F.coalesce(F.col("avaliableCount") == 0, F.lit(False))
    status, said = ({k: v[n] for k, v in SEAT_STATUS.items()} for n in (0, 1))
    address, name = no_zip(F.col("_siteAddress")), text("_siteTitle")
    place = r"^([臺台][北中南東]市|..[市縣])(.{1,3}?區)"
    skipped = F.filter(F.transform("excludedDate", lambda x: trim_all(F.concat_ws(" ", F.coalesce(x["date"], F.lit("")), x["note"]))), lambda s: s != "")
    has_place = F.coalesce(address, F.lit("")).rlike(place)
    slots = F.transform(F.filter(F.transform("week", lambda w: code_map(w, WEEKDAYS)), lambda w: w.isNotNull()), lambda w: slot(w, start, end))
    return course(raw.where(F.col("id").isNotNull() & text("_siteId").isNotNull() & text("title").isNotNull()), "teamxports-centers", F.concat_ws(":", "_siteId", F.col("id").cast("string")), fetched_at, {
        "title": text("title"), "provider.nameRaw": name, "provider.kind": F.lit("sports-center"), "externalIds.centerCourseCode": text("number"), "categoryRaw": text("_categoryName"),
        "schedule.startDate": date("startDate"), "schedule.endDate": date("endDate"), "schedule.recurrence": F.lit("weekly"), "schedule.slots": slots,
        "schedule.timeInfoRaw": F.when(F.size(skipped) > 0, F.concat(F.lit("停課："), F.array_join(skipped, "、"))),
        "enrollment.status": F.when(full, "full").otherwise(F.coalesce(code_map(code, status), F.lit("unknown"))), "enrollment.statusRaw": F.when(full, "已額滿").otherwise(F.coalesce(code_map(code, said), code)),
        "enrollment.opensAt": local("regStartDate"), "enrollment.closesAt": local("regEndDate"), "enrollment.capacity": F.when(F.col("capacityMax") > 0, F.col("capacityMax")), "enrollment.available": F.col("avaliableCount"),
        "price": F.when(F.col("price") > 0, F.col("price")), "location.venueNameRaw": trim_all(F.concat_ws(" ", name, F.get("courtTitles", F.lit(0)))),
        "location.city": tai(group(address, place, 1)), "location.district": group(address, place, 2), "location.addressPrecision": F.when(has_place, "district").otherwise("venue-name-only"),
        "sourceUrl": F.concat(F.lit("https://"), F.lower("_siteHost"), F.lit("/course")), **_term(date("startDate")),
    })


def titled_listing(raw: DataFrame, fetched_at: str) -> DataFrame:
    """The listing that keeps term and time in the title, and seats as enrolled of capacity."""
    title = text("title")
    term, clock = r"^(?:NEW)?\s*(\d{3})_?(0[1-6])(?!\d)", r"(?<!\d)([01]?\d|2[0-3]):([0-5]\d)(?!\d)"
    start = F.when(title.rlike(clock), F.concat(F.lpad(F.regexp_extract(title, clock, 1), 2, "0"), F.lit(":"), F.regexp_extract(title, clock, 2)))
    cap, taken = F.col("capacity"), F.col("enrolled")
    seats = F.when((cap > 0) & taken.isNotNull(), F.greatest(F.lit(0), cap - taken))
    address = no_zip(F.col("_address"))
    has = title.rlike(term)
    price = F.regexp_extract(F.coalesce(text("priceText"), F.lit("")), r"^\$\s*([\d,]+)", 1)
    return course(raw.where(text("ccid").isNotNull() & text("_lid").isNotNull() & title.isNotNull()), "changjia-centers", F.concat_ws(":", "_lid", "ccid"), fetched_at, {
        "title": title, "provider.nameRaw": text("_site"), "provider.kind": F.lit("sports-center"), "schedule.recurrence": F.lit("weekly"),
        "schedule.slots": F.transform("weekDays", lambda d: slot(F.when(d == 0, 7).otherwise(d), start)),
        "term.raw": F.when(has, F.concat_ws("_", F.regexp_extract(title, term, 1), F.regexp_extract(title, term, 2))), "term.year": group(title, term, 1), "term.termNo": group(title, term, 2),
        "enrollment.status": F.when(seats == 0, "full").when(seats > 0, "open").otherwise("unknown"), "enrollment.capacity": F.when(seats.isNotNull(), cap), "enrollment.available": seats, "enrollment.enrolled": F.when(seats.isNotNull(), taken),
        "price": F.replace(price, F.lit(","), F.lit("")).try_cast("double"), "priceText": F.when(price != "", text("priceText")), "categoryRaw": text("_categoryName"), "teachers": teacher(text("teacher")),
        "location.venueNameRaw": F.coalesce(text("place"), text("_site")), "location.address": address, "location.addressPrecision": F.when(address.isNotNull(), "street").otherwise("venue-name-only"), "location.city": county_of(address),
    })


def job_training(raw: DataFrame, fetched_at: str) -> DataFrame:
    """Job training: status by dates against the fetch day; a county written twice is written once."""
    date = lambda c: group(text(c), r"^(\d{4}-\d{2}-\d{2})")
    address = text(F.regexp_replace(text("Address"), r"^(..[市縣])\1+", "$1"))
    opens, closes, price = date("RegisterStartDateTime"), date("RegisterEndDateTime"), number("DEFSTDCOST")
    numbered = address.rlike(HOUSE_NUMBER + "|[0-9]+樓")
    full = F.when(county_of(address).isNotNull() | text("CityName").isNull(), address).otherwise(F.concat(text("CityName"), address))
    return course(raw.where(text("ID").isNotNull() & text("Name").isNotNull()), "taiwanjobs", text("ID"), fetched_at, {
        "title": text("Name"), "provider.nameRaw": text("TrainingUnit"), "provider.kind": F.lit("vocational"), "provider.operatorRaw": text("BranchName"), "provider.planRaw": text("PlanName"),
        "schedule.startDate": date("TrainingStartDateTime"), "schedule.endDate": date("TrainingEndDateTime"), "schedule.recurrence": F.lit("irregular"), "schedule.timeInfoRaw": text("TrainingTime"), "schedule.hours": F.when(number("THOURS") > 0, number("THOURS")),
        "enrollment.status": _window(opens, closes, fetched_at[:10]), "enrollment.opensAt": opens, "enrollment.closesAt": closes, "enrollment.capacity": F.when(number("TNUM") > 0, number("TNUM")), "enrollment.registerUrl": text("Url"),
        "location.venueNameRaw": F.coalesce(address, text("CourseLocation")), "location.address": F.when(numbered, full), "location.city": text("CityName"),
        "location.addressPrecision": F.when(address.isNull(), "city").when(numbered, "street").otherwise("district"),
        "price": price, "isFree": price == 0, "categoryRaw": text("Category"), "externalIds.taiwanjobs": text("SourcePrimaryKey"), "sourceUrl": text("Url"), "sourceUpdatedAt": text("UpdateTime"),
    })


def pre_job_training(raw: DataFrame, fetched_at: str) -> DataFrame:
    """Pre-job training: dates padded and split at a tilde, the student's own share as the price."""
    # what is read many times is a column of its own, so that no expression repeats another's
    ends = {"__start": ("訓練期間", 0), "__end": ("訓練期間", 1), "__opens": ("報名期間", 0), "__closes": ("報名期間", 1)}
    raw = raw.withColumns({name: trim_all(F.get(F.split(F.coalesce(text(c), F.lit("")), "[~～]"), F.lit(n))) for name, (c, n) in ends.items()})
    raw = raw.withColumns({name: D.ymd(F.col(name)) for name in ends})
    start, end, opens, closes = (F.col(name) for name in ends)
    city, district, street = text("訓練縣市"), text("訓練區域"), text("訓練地址")
    address = F.when(street.startswith(F.coalesce(city, F.lit(""))), street).otherwise(F.concat(F.coalesce(city, F.lit("")), F.coalesce(district, F.lit("")), street))
    numbered = F.coalesce(address.rlike(HOUSE_NUMBER + r"|[0-9]+\s*樓"), F.lit(False))
    price = group(text("經費"), r"學員負擔[：:]\s*([\d,]+)")
    price = F.replace(price, F.lit(","), F.lit("")).try_cast("double")
    no = F.when(text("數量").rlike("^[1-9][0-9]*$"), text("數量"))
    body = lambda c: F.array_join(F.filter(F.transform(F.split(text(c), r"\^"), trim_all), lambda x: x != ""), "\n")
    return course(raw.where(text("課程編號").isNotNull() & text("課程名稱").isNotNull()), "mol-6060", text("課程編號"), fetched_at, {
        "title": text("課程名稱"), "provider.nameRaw": F.coalesce(text("訓練單位名稱"), text("分署")), "provider.kind": F.lit("vocational"), "provider.operatorRaw": text("單位名稱"),
        "schedule.startDate": start, "schedule.endDate": end, "schedule.recurrence": F.lit("irregular"), "schedule.timeInfoRaw": text("訓練時段"), "schedule.hours": F.when(number("訓練時數") > 0, number("訓練時數")),
        "enrollment.status": _window(opens, closes, fetched_at[:10]), "enrollment.opensAt": opens, "enrollment.closesAt": closes, "enrollment.registerUrl": text("網址"),
        "location.city": city, "location.district": district, "location.address": F.when(numbered, address), "location.venueNameRaw": text("訓練單位名稱"),
        "location.addressPrecision": F.when(numbered, "street").when(district.isNotNull(), "district").otherwise("city"),
        "externalIds.taiwanjobs": text("課程編號"), "term.raw": no, "term.termNo": no, "term.year": F.when(no.isNotNull(), F.substring(start, 1, 4).try_cast("int") - 1911),
        "price": price, "isFree": price == 0, "priceText": F.when(price.isNotNull(), text("經費")), "sourceUrl": text("網址"),
        "description": F.nullif(F.concat_ws("\n", body("訓練目標"), body("課程內容")), F.lit("")),
    })


def nature_courses(raw: DataFrame, fetched_at: str) -> DataFrame:
    """Nature education: a closing rule that is no date stays a rule."""
    url, ends = text("url"), text("onAskEnd")
    iso = lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)
    code = F.coalesce(group(url, "(?i)[?&]id=([^&]+)"), url)
    return course(raw.where(url.isNotNull() & text("NAduName").isNotNull()), "forest-nature-edu", code, fetched_at, {
        "title": text("NAduName"), "provider.nameRaw": text("AduName"), "provider.kind": F.lit("other"), "enrollment.status": _window(iso(text("onAskStartDay")), iso(ends), fetched_at[:10]),
        "enrollment.opensAt": iso(text("onAskStartDay")), "enrollment.closesAt": iso(ends), "enrollment.closesRuleRaw": F.when(iso(ends).isNull(), ends), "enrollment.registerUrl": url,
        "location.venueNameRaw": text("AduName"), "location.addressPrecision": F.lit("venue-name-only"), "externalIds.forestCourseCode": code, "sourceUrl": url,
    })


def senior_points(raw: DataFrame, fetched_at: str) -> DataFrame:
    """Senior centres of one city: the record id joins place, title and dates."""
    iso = lambda c: F.when(text(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), text(c))
    place, start, end = text("地點"), iso("開課起始日期"), iso("開課結束日期")
    year = F.substring(start, 1, 4).try_cast("int") - 1911
    key = F.concat_ws("|", place, text("課程名稱"), F.coalesce(start, F.lit("")), F.coalesce(end, F.lit("")))
    size = F.when(text("人數").rlike("^[1-9][0-9]*$"), text("人數"))
    return course(raw.where(place.isNotNull() & text("課程名稱").isNotNull()), "taipei-senior-points", key, fetched_at, {
        "title": text("課程名稱"), "audienceRaw": F.lit("銀髮族"), "provider.nameRaw": place, "provider.kind": F.lit("senior-center"), "provider.phoneRaw": text("電話"), "teachers": teacher(text("授課老師")),
        "schedule.startDate": start, "schedule.endDate": end, "enrollment.status": F.lit("unknown"), "enrollment.capacity": size, "term.year": F.when(year > 0, year),
        "location.venueNameRaw": place, "location.city": F.lit("臺北市"), "location.district": group(place, "^臺北市(中正區|大同區|中山區|松山區|大安區|萬華區|信義區|士林區|北投區|內湖區|南港區|文山區)"), "location.addressPrecision": F.lit("venue-name-only"),
    })


def _collapsed(df: DataFrame, order: str, sets: list[str], largest: list[str]) -> DataFrame:
    """One row for each key ``k``: the first row's fields, sorted sets, largest values."""
    first = [c for c in df.columns if c not in {"k", order, *sets, *largest}]
    return df.groupBy("k").agg(*[F.min_by(c, order).alias(c) for c in first], *[F.array_sort(F.collect_set(c)).alias(c) for c in sets], *[F.max(c).alias(c) for c in largest])


def _ordered(raw: DataFrame, order: str | None) -> tuple[DataFrame, str]:
    """The input order as a column: given, or the place in the landed files."""
    return (raw, order) if order else (raw.withColumn("__ord", F.monotonically_increasing_id()), "__ord")


def sports_venues(raw: DataFrame, fetched_at: str, order: str | None = None) -> DataFrame:
    """The venue register: one row a facility becomes one row a venue."""
    raw, at = _ordered(raw, order)
    some = lambda c: F.when(text(c) != "NULL", text(c))
    address = tai(no_zip(some("地址")))
    city = F.coalesce(county_of(address), code_map(text("縣市"), COUNTY_CODES))
    lat, lng = number("緯度"), number("經度")
    rows = raw.select(at, some("場館名稱").alias("name"), address.alias("address"), city.alias("city"), some("場館分類").alias("facilities"), some("場館隸屬機關屬性").alias("kindRaw"), some("行政區").alias("district"), some("場館實際管理人電話").alias("phone"), some("場館官方網站").alias("website"), F.when((lat > 20) & (lat < 27), lat).alias("lat"), F.when((lng > 118) & (lng < 123), lng).alias("lng"))
    rows = rows.where("name is not null and city is not null").withColumn("k", F.concat_ws("|", "city", "name", F.coalesce("address", F.lit(""))))
    out = _collapsed(rows, at, ["facilities"], [])
    return venue(out, "sports-venues", F.col("k"), fetched_at, {c: F.col(c) for c in out.columns if c != "k"})


def college_sites(raw: DataFrame, fetched_at: str, order: str | None = None) -> DataFrame:
    """College sites: schools that use a site, sorted, and its latest year."""
    raw, at = _ordered(raw, order)
    rows = raw.select(at, text("據點名稱").alias("name"), no_zip(text("據點地址")).alias("address"), text("縣市別").alias("city"), text("社區大學名稱").alias("usedByRaw"), text("年度").alias("latestYear"))
    rows = rows.where("name is not null and city is not null").withColumn("k", F.concat_ws("|", "city", "name", F.coalesce("address", F.lit(""))))
    out = _collapsed(rows, at, ["usedByRaw"], ["latestYear"])
    return venue(out, "moe-cc-sites", F.col("k"), fetched_at, {c: F.col(c) for c in out.columns if c != "k"} | {"kindRaw": F.lit("社區大學據點")})


def senior_centers(raw: DataFrame, fetched_at: str, order: str | None = None) -> DataFrame:
    """Senior learning centres: the first row of each city and name."""
    raw, at = _ordered(raw, order)
    rows = raw.withColumn("k", F.concat_ws("|", text("縣市"), text("樂齡中心名稱"))).where(text("縣市").isNotNull() & text("樂齡中心名稱").isNotNull())
    one = Wn.keep_first(rows, ["k"], [F.col(at)])
    return venue(one, "moe-senior-centers", F.col("k"), fetched_at, {"name": text("樂齡中心名稱"), "kindRaw": F.lit("樂齡學習中心"), "city": text("縣市"), "district": text("鄉鎮市區名稱"), "address": no_zip(text("中心地址")), "phone": text("中心電話")})


def school_directory(raw: DataFrame, fetched_at: str, order: str | None = None) -> DataFrame:
    """Schools: the latest year of each file and code; only addresses with a house number."""
    raw, at = _ordered(raw, order)
    clean = lambda c: tai(no_zip(text(c)))
    rows = raw.where(text("代碼").isNotNull() & text("學校名稱").isNotNull()).withColumn("k", F.concat_ws(":", "_file", text("代碼"))).withColumn("y", F.coalesce(number("學年度"), F.lit(0.0)))
    one = Wn.keep_first(rows, ["k"], [F.col("y").desc(), F.col(at)]).where(clean("地址").rlike(r"[\d零〇一二三四五六七八九十百]+\s*號"))
    return venue(one, "moe-school-directory", F.col("k"), fetched_at, {"name": clean("學校名稱"), "address": clean("地址"), "kindRaw": F.col("_kind"), "city": F.coalesce(county_of(clean("縣市名稱")), county_of(clean("地址"))), "website": F.when(text("網址").startswith("http"), text("網址"))})


def city_sports_centers(raw: DataFrame, fetched_at: str, order: str | None = None) -> DataFrame:
    """One city's sports centres: the first row of each name; coordinates in pairs or not at all."""
    raw, at = _ordered(raw, order)
    one = Wn.keep_first(raw.where(text("名稱").isNotNull()).withColumn("k", text("名稱")), ["k"], [F.col(at)])
    ok = in_taiwan(number("緯度"), number("經度"))
    return venue(one, "taipei-sports-centers", F.col("k"), fetched_at, {"name": text("名稱"), "kindRaw": F.lit("國民運動中心"), "city": F.lit("臺北市"), "district": group(text("地址"), "^臺北市(..區)"), "address": text("地址"), "lat": F.when(ok, number("緯度")), "lng": F.when(ok, number("經度")), "phone": text("電話"), "website": text("網址")})


#: Status words and semester numbers of the county college portals.
PORTAL_STATUS = {"公布": "open", "招生中": "open", "已開課": "running", "開課中": "running", "額滿": "full", "已額滿": "full", "停召": "cancelled", "停招": "cancelled", "停開": "cancelled"}
PORTAL_SEASONS = {"1": "spring", "2": "autumn", "3": "winter", "4": "summer"}


def college_portal(raw: DataFrame, fetched_at: str, source: str, city: str, site: str, every_weekday: bool) -> DataFrame:
    """A county college portal: weekdays in words, seats as enrolled and capacity.

    ``every_weekday`` makes each weekday named a slot; else only the first one is.
    """
    said = F.regexp_extract_all(F.coalesce(text("timeText"), F.lit("")), F.lit("星期([一二三四五六日])"), F.lit(1))
    days = F.transform(F.array_distinct(said), lambda w: code_map(w, WEEKDAYS))
    days = days if every_weekday else F.slice(days, 1, 1)
    label = text(F.regexp_replace("_semesterLabel", r"\s+", " "))
    year = group(label, r"(\d{3})\s*年度").try_cast("int")
    cap, taken = F.col("capacity"), F.col("enrolled")
    seats = F.when(cap.isNotNull() & taken.isNotNull(), F.greatest(F.lit(0), cap - taken))
    status = F.coalesce(code_map(text("statusText"), PORTAL_STATUS), F.lit("unknown"))
    tags = F.array_compact(F.array(text("tagText"), text("discountText")))
    df = raw.where(text("courseId").isNotNull() & text("courseName").isNotNull())
    return course(df, source, F.concat_ws(":", "_semester", "courseId"), fetched_at, {
        "title": text("courseName"), "provider.nameRaw": text("school"), "provider.kind": F.lit("community-college"),
        "schedule.recurrence": F.lit("weekly"), "schedule.slots": F.transform(days, lambda w: slot(w)), "schedule.timeInfoRaw": text("timeText"), "schedule.sessionsPerWeek": F.when(F.lit(every_weekday) & (F.size(days) > 0), F.size(days)),
        "enrollment.status": F.when((seats == 0) & (status == "open"), "full").otherwise(status), "enrollment.statusRaw": text("statusText"), "enrollment.capacity": cap, "enrollment.enrolled": taken, "enrollment.available": seats,
        "location.city": F.lit(city), "location.addressPrecision": F.lit("city"), "topicsRaw": F.when(F.size(tags) > 0, tags), "sourceUrl": F.concat(F.lit(site), text("courseId")),
        "term.raw": F.when(year > 0, label), "term.year": F.when(year > 0, year), "term.season": F.when(year > 0, code_map(group(label, r"第\s*(\d)\s*學期"), PORTAL_SEASONS)),
    })


def taichung_portal(raw: DataFrame, fetched_at: str) -> DataFrame:
    return college_portal(raw, fetched_at, "taichung-cc", "臺中市", "https://cc.tc.edu.tw/view/", False)


def hualien_portal(raw: DataFrame, fetched_at: str) -> DataFrame:
    return college_portal(raw, fetched_at, "hualien-cc", "花蓮縣", "https://hualien.cloudschool.com.tw/view/", True)


def first_wins(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One row for each record id: the first."""
    return Wn.keep_first(rows, ["_source", "_sourceRecordId"], order)


def drop_inverted(rows: DataFrame) -> DataFrame:
    """An end before the start is no end."""
    bad = D.is_inverted(F.col("schedule.startDate"), F.col("schedule.endDate"))
    return rows.withColumn("schedule", F.when(bad, F.col("schedule").withField("endDate", F.lit(None).cast("string"))).otherwise(F.col("schedule")))


NORMALIZERS: dict[str, Callable[..., DataFrame]] = {
    "moe-cc-courses": college_courses,
    "xuanen-centers": seat_bookings,
    "teamxports-centers": seat_listing,
    "changjia-centers": titled_listing,
    "taiwanjobs": job_training,
    "taichung-cc": taichung_portal,
    "hualien-cc": hualien_portal,
    "mol-6060": pre_job_training,
    "forest-nature-edu": nature_courses,
    "taipei-senior-points": senior_points,
    "sports-venues": sports_venues,
    "moe-cc-sites": college_sites,
    "moe-senior-centers": senior_centers,
    "moe-school-directory": school_directory,
    "taipei-sports-centers": city_sports_centers,
}
