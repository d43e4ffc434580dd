"""Mappings of community college portals: raw records to listing rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import no_space, tai, trim_all
from ..operators.rules import classify, code_map
from .normalize import HOUSE_NUMBER, WEEKDAYS, college_values, course, group, number, slot, teacher, text

#: Words for seasons, in the order they are tried.
SEASON_WORDS = [("秋", "autumn"), ("春", "spring"), ("暑", "summer"), ("寒", "winter")]
LOOSE_SEASONS = [("秋季", "autumn"), ("春季", "spring"), ("暑期|暑假", "summer"), ("寒假|寒期", "winter")]
CITY_SEASONS = [(r"秋季班|第\s*2\s*期|第2學期", "autumn"), (r"春季班|第\s*1\s*期|第1學期", "spring"), ("暑期班|暑假班", "summer"), ("寒假班", "winter")]
#: Status words.
CITY_STATUS = {"招生中": "open", "即將開課": "open", "額滿": "full", "開課中": "running", "已開課": "running", "停招": "cancelled", "停課": "cancelled", "其它": "unknown"}
SHARED_STATUS = {"招生中": "open", "報名中": "open", "額滿": "full", "已額滿": "full", "開課中": "running", "已開課": "running", "停開": "cancelled", "停招": "cancelled", "結束": "closed", "已結束": "closed"}
NEW_CITY_STATUS = {"招生中": "open", "開課中": "running", "已開課": "running", "額滿": "full", "停課中": "cancelled", "停招": "cancelled", "已結束": "closed"}
#: Kinds of providers.
CITY_KINDS = {"社區大學": "community-college", "樂齡學堂": "senior-center", "樂齡學習中心": "senior-center", "成人教育班": "adult-education", "成人基本教育研習班": "adult-education", "國中小進修部": "school-continuing"}
LEARNING_KINDS = [("樂齡", "senior-center"), ("松年", "senior-center"), ("婦女", "women-center"), ("社區大學|社大", "community-college")]
#: Districts of one county, and townships of another by their short names.
ISLAND_DISTRICTS = ("馬公市", "湖西鄉", "白沙鄉", "西嶼鄉", "望安鄉", "七美鄉")
TOWNSHIPS = "斗六市 斗南鎮 虎尾鎮 西螺鎮 土庫鎮 北港鎮 古坑鄉 大埤鄉 莿桐鄉 林內鄉 二崙鄉 崙背鄉 麥寮鄉 東勢鄉 褒忠鄉 臺西鄉 元長鄉 四湖鄉 口湖鄉 水林鄉".split()

CHINESE_NUMBER = r"[0-9]+\s*號|[一二三四五六七八九十]+號"


def blank(c: str | Column) -> Column:
    """A text, '' where it is missing."""
    return F.coalesce(text(c), F.lit(""))


def whole(c: str | Column) -> Column:
    """The first whole number in a text."""
    return group(text(c), r"([0-9]+)").try_cast("int")


def weekday_in(s: Column, pattern: str = "星期([一二三四五六日])") -> Column:
    return code_map(group(s, pattern), WEEKDAYS)


def clocks(s: Column, pattern: str) -> tuple[Column, Column]:
    """(start, end) as HH:MM from a pattern with four numbers; null if it does not fit."""
    part = lambda n: F.lpad(group(s, pattern, n).try_cast("int").cast("string"), 2, "0")
    return F.concat(part(1), F.lit(":"), part(2)), F.concat(part(3), F.lit(":"), part(4))


def term(raw: Column, year: str, seasons: list[tuple[str, str]]) -> dict[str, Column]:
    """Term columns of a label; without a year there is no term."""
    y = group(raw, year).try_cast("int")
    known = y > 0
    return {"term.raw": F.when(known, raw), "term.year": F.when(known, y), "term.season": F.when(known, classify(raw, seasons))}


def people(s: Column, separators: str) -> Column:
    """Names that separators part; null if there are none."""
    names = F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), separators), trim_all), lambda x: x != "")
    return F.when(F.size(names) > 0, F.transform(names, lambda x: F.struct(x.alias("nameRaw"))))


def some_slots(*slots: Column) -> Column:
    return F.array_compact(F.array(*slots))


def sane_date(c: str) -> Column:
    """The date part of a time in this century."""
    return group(text(c), r"^(20[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|2100-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))")


def college_details(raw: DataFrame, fetched_at: str) -> DataFrame:
    """Detail records of the national college listing: codes and introductions, no county."""
    intro = text(F.regexp_replace(blank("course_intro"), r'(?s)^"(.*)"$', "$1"))
    return course(raw.where(text("course_id").isNotNull()), "moe-cc-detail", text("course_id"), fetched_at, college_values() | {"externalIds.schoolCourseCode": text("internal_course_code"), "description": intro})


def city_courses(raw: DataFrame, fetched_at: str) -> DataFrame:
    """The capital's course network: a slot for every weekday, two ways to write times."""
    said = F.coalesce(text("classTime"), F.lit(""))
    colon, digits = clocks(said, r"(\d{1,2}):(\d{2})\s*[-~]\s*(\d{1,2}):(\d{2})"), clocks(said, r"^(\d{2})(\d{2})\s*[-~]\s*(\d{2})(\d{2})$")
    start, end = F.coalesce(colon[0], digits[0]), F.coalesce(colon[1], digits[1])
    days = F.filter(F.transform(F.coalesce("dayInWeekId", F.array().cast("array<string>")), lambda d: d.try_cast("int")), lambda d: d.between(1, 7))
    slots = F.when(F.size(days) > 0, F.transform(days, lambda d: slot(d, start, end))).when(start.isNotNull(), F.array(slot(F.lit(None), start, end))).otherwise(F.array().cast("array<struct<weekday:int,startTime:string,endTime:string>>"))
    place, district, price = text("address"), text("district"), number("tuition")
    street = F.coalesce(place.rlike(CHINESE_NUMBER), F.lit(False))
    return course(raw.where(text("_id").isNotNull() & text("name").isNotNull()), "taipei-cc", text("_id"), fetched_at, {
        "title": text("name"), "provider.nameRaw": text("school"), "provider.kind": F.coalesce(code_map(text("cg"), CITY_KINDS), F.lit("other")),
        "schedule.startDate": sane_date("startDate"), "schedule.endDate": sane_date("endDate"), "schedule.recurrence": F.when(F.size(slots) > 1, "twice-weekly").otherwise("weekly"), "schedule.slots": slots,
        "enrollment.status": F.coalesce(code_map(text("openStatus"), CITY_STATUS), F.lit("unknown")), "enrollment.statusRaw": text("openStatus"), "enrollment.noteRaw": text("comment"),
        "location.venueNameRaw": place, "location.city": F.lit("臺北市"), "location.district": district,
        "location.address": F.when(street, F.when(place.rlike("^[臺台]北市"), place).otherwise(F.concat(F.lit("臺北市"), F.coalesce(district, F.lit("")), place))),
        "location.addressPrecision": F.when(street, "street").when(place.isNotNull(), "venue-name-only").when(district.isNotNull(), "district").otherwise("city"),
        "externalIds.schoolCourseCode": text("code"), "sourceUrl": text("classLink"), "sourceUpdatedAt": text("modifiedAt"), "description": text("requirement"), "categoryRaw": text("lcg"), "teachers": teacher(text("teacher")),
        "price": price, "isFree": price == 0, "priceText": F.when(price.isNull(), text("tuition")),
        "term.raw": text("semester"), "term.year": group(text("semester"), r"(\d{3})\s*年"), "term.season": classify(text("semester"), CITY_SEASONS),
    })


def shared_platform(raw: DataFrame, fetched_at: str) -> DataFrame:
    """The platform that several colleges share: places by position in the address."""
    weekday, start, end, said = code_map(text("weekdayText"), WEEKDAYS), text("timeBegin"), text("timeEnd"), text("statusText")
    address, area = tai(text("addressText")), text("areaText")
    numbered = F.coalesce(address.rlike(HOUSE_NUMBER), F.lit(False))
    return course(raw.where(text("courseHash").isNotNull() & text("title").isNotNull()), "cc-shared-platform", F.concat_ws(":", "host", "courseHash"), fetched_at, {
        "title": text("title"), "provider.nameRaw": F.coalesce(text("schoolName"), text("schoolLine"), text("host")), "provider.kind": F.lit("community-college"),
        "schedule.recurrence": F.lit("weekly"), "schedule.slots": some_slots(F.when(F.coalesce(weekday.cast("string"), start, end).isNotNull(), slot(weekday, start, end))), "schedule.startDate": text("startDate"), "schedule.timeInfoRaw": text("timeOfDay"),
        "enrollment.status": F.coalesce(code_map(said, SHARED_STATUS), F.lit("unknown")), "enrollment.statusRaw": said, "enrollment.openFlagRaw": F.when(~text("openFlag").eqNullSafe(said), text("openFlag")), "enrollment.capacity": whole("capacityText"),
        "location.venueNameRaw": F.coalesce(address, area), "location.address": F.when(numbered, address), "location.city": group(address, "^(..[市縣])"), "location.district": group(address, "^..[市縣](..[區鄉鎮市])"),
        "location.addressPrecision": F.when(numbered, "street").when(F.coalesce(address, area).isNotNull(), "venue-name-only").otherwise("none"),
        "teachers": teacher(text("teacher")), "externalIds.schoolCourseCode": text("courseCode"), "description": text("note"), "sourceUrl": text("url"), **term(text("termText"), r"(\d{3})", LOOSE_SEASONS),
    })


def new_city_courses(raw: DataFrame, fetched_at: str) -> DataFrame:
    """Term from the starting month; January belongs to the winter of the year before."""
    title, start = text("課程名稱"), text("開課日期")
    year, month = group(start, r"^(\d{4})-").try_cast("int") - 1911, group(start, r"^\d{4}-(\d{1,2})").try_cast("int")
    season = F.when(month.between(2, 6), "spring").when(month == 7, "summer").when(month.between(8, 12), "autumn").when(month == 1, "winter")
    year = F.when(season == "winter", year - 1).when(season.isNotNull(), year)
    bare = text(F.regexp_replace(title, r"^【[^】]*】\s*", ""))
    day = weekday_in(text("授課星期"), "^星期([一二三四五六日])$")
    return course(raw.where(text("classId").isNotNull() & title.isNotNull()), "ntpc-cc", text("classId"), fetched_at, {
        "title": title, "titleNormalized": F.when(bare != title, bare), "provider.nameRaw": text("授課社大"), "provider.kind": F.lit("community-college"),
        "schedule.recurrence": F.lit("weekly"), "schedule.slots": some_slots(F.when(day.isNotNull(), slot(day))), "schedule.startDate": start,
        "enrollment.status": F.coalesce(code_map(text("開課狀況"), NEW_CITY_STATUS), F.lit("unknown")), "enrollment.statusRaw": text("開課狀況"),
        "location.city": F.lit("新北市"), "location.district": text("行政區"), "location.addressPrecision": F.when(text("行政區").isNotNull(), "district").otherwise("city"),
        "categoryRaw": text("課程類別"), "teachers": teacher(text("授課教師")), "sourceUrl": F.concat(F.lit("https://cci.ntpc.edu.tw/cht/"), blank("detailPath")),
        "term.raw": F.concat(year.cast("string"), code_map(season, {"spring": "春", "summer": "暑", "autumn": "秋", "winter": "寒"})), "term.year": year, "term.season": F.when(year.isNotNull(), season),
    })


def learning_network(raw: DataFrame, fetched_at: str) -> DataFrame:
    """The learning network of one city: kind by the provider's name, status by the enrolment period."""
    span = r"([\d-]{10})\s*([\d:]{5})?\s*[~－-]\s*([\d-]{10})\s*([\d:]{5})?"
    said, today = text("registerRange"), fetched_at[:10]
    moment = lambda n: F.concat(group(said, span, n), F.lit("T"), F.coalesce(group(said, span, n + 1), F.lit("00:00")), F.lit(":00+08:00"))
    opens, closes = moment(1), moment(3)
    status = F.when(F.substring(closes, 1, 10) < today, "closed").when(F.substring(opens, 1, 10) > today, "upcoming").when(opens.isNotNull() & closes.isNotNull(), "open").otherwise("unknown")
    return course(raw.where(text("courseId").isNotNull() & text("title").isNotNull()), "ntpc-ezlearn", text("courseId"), fetched_at, {
        "title": text("title"), "provider.nameRaw": text("providerText"), "provider.kind": F.coalesce(classify(blank("providerText"), LEARNING_KINDS), F.lit("other")),
        "schedule.recurrence": F.lit("weekly"), "schedule.slots": some_slots(F.lit(None).cast("struct<weekday:int,startTime:string,endTime:string>")), "schedule.startDate": group(text("startDateText"), r"(\d{4}-\d{2}-\d{2})"),
        "enrollment.status": status, "enrollment.opensAt": opens, "enrollment.closesAt": closes, "enrollment.capacity": whole("capacityText"),
        "location.city": F.lit("新北市"), "location.district": text("areaText"), "location.addressPrecision": F.when(text("areaText").isNotNull(), "district").otherwise("city"),
        "categoryRaw": text("categoryText"), "sourceUrl": F.concat(F.lit("https://ezlearn.ntpc.gov.tw/courses/detail/"), text("courseId")),
    })


def taoyuan_portal(raw: DataFrame, fetched_at: str) -> DataFrame:
    """Weekdays without hours; a leading picture sign is no part of a label."""
    day, label = weekday_in(text("weekdayText"), "^星期([一二三四五六日])$"), text(F.regexp_replace(blank("discountText"), r"^(\x{1F525}|\x{1F389})\s*", ""))
    return course(raw.where(text("courseId").isNotNull() & text("courseName").isNotNull()), "taoyuan-cc-portal", text("courseId"), fetched_at, {
        "title": text("courseName"), "provider.nameRaw": text("organizer"), "provider.kind": F.lit("community-college"),
        "schedule.recurrence": F.lit("weekly"), "schedule.slots": some_slots(F.when(day.isNotNull(), slot(day))), "schedule.startDate": group(text("startDate"), r"^(\d{4}-\d{2}-\d{2})$"), "schedule.timeInfoRaw": text("timeOfDay"),
        "enrollment.status": F.lit("unknown"), "location.city": F.lit("桃園市"), "location.addressPrecision": F.lit("city"), "categoryRaw": text("categoryText"), "courseTypeRaw": text("courseTypeText"),
        "topicsRaw": F.when(label.isNotNull(), F.array(label)), "sourceUrl": F.coalesce(text("detailUrl"), F.concat(F.lit("https://ta.twcc.org.tw/front/course_detail.php?id="), text("courseId"))), **term(text("semesterText"), r"(\d{3})", SEASON_WORDS),
    })


def tainan_portal(raw: DataFrame, fetched_at: str) -> DataFrame:
    """Midnight to midnight is no time; any remark on the status is a cancellation."""
    day, dates = weekday_in(text("gridWeekdayText")), r"(\d{4}-\d{2}-\d{2})\s*~\s*(\d{4}-\d{2}-\d{2})"
    start, end = clocks(text("timeText"), r"(\d{1,2}):(\d{2})\s*~\s*(\d{1,2}):(\d{2})")
    none = (start == "00:00") & (end == "00:00")
    room, said = text("roomText"), text("statusRaw")
    return course(raw.where(text("courseId").isNotNull() & text("title").isNotNull()), "tainan-cc-portal", text("courseId"), fetched_at, {
        "title": text("title"), "provider.nameRaw": F.coalesce(text("schoolName"), F.lit("臺南市社區大學")), "provider.kind": F.lit("community-college"),
        "schedule.recurrence": F.lit("weekly"), "schedule.slots": some_slots(F.when(day.isNotNull(), slot(day, F.when(~none, start), F.when(~none, end)))), "schedule.sessionsPerWeek": F.when(day.isNotNull(), 1),
        "schedule.startDate": group(text("dateText"), dates, 1), "schedule.endDate": group(text("dateText"), dates, 2), "enrollment.status": F.when(said.isNotNull(), "cancelled").otherwise("unknown"), "enrollment.statusRaw": said,
        "location.city": F.lit("臺南市"), "location.venueNameRaw": room, "location.addressPrecision": F.when(room.isNotNull(), "venue-name-only").otherwise("city"),
        "teachers": people(text("teacherText"), r"[、,，\s／/]+"), "sourceUrl": text("url"), **term(no_space(text("termText")), r"(\d{3})年度", SEASON_WORDS),
    })


def nantou_portal(raw: DataFrame, fetched_at: str) -> DataFrame:
    """Several weekdays in one text; enrolled and remaining make the capacity, cancellations beat full."""
    chunks = F.filter(F.split(blank("timeText"), "(?=星期[一二三四五六日])"), lambda c: c.rlike("星期[一二三四五六日]"))
    hours = r"(\d{1,2})\s*時\s*(\d{1,2})\s*分\s*~\s*(\d{1,2})\s*時\s*(\d{1,2})\s*分"
    one = F.transform(chunks, lambda c: slot(weekday_in(c), *_minutes(c, hours)))
    grid = weekday_in(text("gridWeekdayText"))
    slots = F.when(F.size(one) > 0, one).otherwise(some_slots(F.when(grid.isNotNull(), slot(grid))))
    taken, free, said, full = whole("enrolledText"), whole("remainingText"), text("immediateText"), F.coalesce(F.col("fullFlag").cast("boolean"), F.lit(False))
    venue, title = F.coalesce(text("venueText"), text("classroom")), F.coalesce(text("detailTitle"), text("title"))
    return course(raw.where(text("courseId").isNotNull() & title.isNotNull()), "nantou-cc-portal", text("courseId"), fetched_at, {
        "title": title, "provider.nameRaw": F.coalesce(text("schoolName"), text("unitName")), "provider.kind": F.lit("community-college"), "provider.campusRaw": text("campusName"),
        "schedule.recurrence": F.lit("weekly"), "schedule.slots": slots, "schedule.sessionsPerWeek": F.when(F.size(slots) > 0, F.size(slots)), "schedule.weeks": whole("weeksText"), "schedule.hours": whole("hoursText"), "schedule.timeInfoRaw": text("periodText"),
        "enrollment.enrolled": taken, "enrollment.available": F.when(full, 0).otherwise(free), "enrollment.capacity": F.when(taken.isNotNull() & free.isNotNull(), taken + free).otherwise(whole("capacityText")),
        "enrollment.status": F.when(said.rlike("不開班|停開|停招|停課"), "cancelled").when(full, "full").when(free > 0, "open").when(free == 0, "full").otherwise("unknown"), "enrollment.statusRaw": said, "enrollment.reviewStatusRaw": text("reviewStatusText"),
        "categoryRaw": text("categoryText"), "topicsRaw": F.when(text("groupText").isNotNull(), F.array(text("groupText"))), "audienceRaw": text("audienceText"), "credit": whole("creditText"), "description": F.coalesce(text("outlineText"), text("goalText")),
        "teachers": people(F.coalesce(text("teacherText"), text("teacher")), r"[、,，\s]+"), "priceText": F.concat(F.lit("課程相關費用："), text("feeText")),
        "location.city": F.lit("南投縣"), "location.venueNameRaw": venue, "location.addressPrecision": F.when(venue.isNotNull(), "venue-name-only").otherwise("city"), "sourceUrl": text("url"),
        **term(no_space(F.coalesce(text("detailTermText"), text("termText"))), r"(\d{3})\s*年度", SEASON_WORDS),
    })


def _minutes(s: Column, pattern: str) -> tuple[Column, Column]:
    """Start and end whose minutes may be written with one digit."""
    part = lambda n: F.lpad(group(s, pattern, n), 2, "0")
    return F.concat(part(1), F.lit(":"), part(2)), F.concat(part(3), F.lit(":"), part(4))


def penghu_portal(raw: DataFrame, fetched_at: str) -> DataFrame:
    """Districts by name, then a house number behind them; several slots a course."""
    clock = r"(\d{1,2})\s*:\s*(\d{2})\s*[-~～]\s*(\d{1,2})\s*:\s*(\d{2})"
    slots = F.transform(F.coalesce("slotsText", F.array().cast("array<struct<weekdayText:string,timeText:string>>")), lambda s: F.struct(weekday_in(s["weekdayText"], "[週星期]期?([一二三四五六日])").alias("day"), s["timeText"].alias("time")))
    slots = F.transform(F.filter(slots, lambda s: s["day"].isNotNull()), lambda s: slot(s["day"], *clocks(s["time"], clock)))
    venue = text("venueText")
    district = F.lit(None).cast("string")
    for d in reversed(ISLAND_DISTRICTS):
        district = F.when(F.contains(venue, F.lit(d)), d).otherwise(district)
    behind = F.substring(venue, F.instr(venue, district) + F.length(district), F.length(venue))
    house = group(behind, r"^([^()（）]*?[0-9]+\s*號)")
    title, info = F.coalesce(text("detailTitle"), text("titleText")), text("detailTimeText")
    return course(raw.where(text("courseId").isNotNull() & title.isNotNull()), "penghu-cc-portal", text("courseId"), fetched_at, {
        "title": title, "provider.nameRaw": F.lit("澎湖縣社區大學"), "provider.kind": F.lit("community-college"), "enrollment.status": F.lit("unknown"),
        "schedule.recurrence": F.lit("weekly"), "schedule.slots": slots, "schedule.sessionsPerWeek": F.when(F.size(slots) > 0, F.size(slots)), "schedule.hours": group(info, r"共\s*(\d+)\s*小時"), "schedule.timeInfoRaw": F.when(F.size(slots) == 0, info),
        "courseCodeRaw": text("codeText"), "categoryRaw": text("categoryText"), "audienceRaw": text("audienceText"), "description": text("goalText"), "teachers": people(F.coalesce(text("teacherName"), text("teacherText")), r"[、,，／/\s]+"), "priceText": F.concat(F.lit("教材費用："), text("materialFeeText")),
        "location.city": F.lit("澎湖縣"), "location.venueNameRaw": venue, "location.district": district, "location.address": no_space(F.concat(F.lit("澎湖縣"), district, house)),
        "location.addressPrecision": F.when(house.isNotNull(), "street").when(district.isNotNull(), "district").when(venue.isNotNull(), "venue-name-only").otherwise("city"),
        "sourceUrl": text("url"), "sourceUpdatedAt": text("updatedText"), **term(no_space(text("termText")), r"(\d{3})年", SEASON_WORDS),
    })


def yunlin_portal(raw: DataFrame, fetched_at: str) -> DataFrame:
    """Township by short name; one school also counts unpaid places; a full mark beats subtraction."""
    day = weekday_in(text("c_week"), "^星期([一二三四五六日])$")
    clock = lambda c: F.when(text(c).rlike(r"^\d{1,2}:\d{2}"), text(c))
    full, cap = text("full"), F.when(text("c_UpperLimit").try_cast("int") > 0, text("c_UpperLimit").try_cast("int"))
    taken = text("c_now").try_cast("int") + F.when(F.col("_school") == "seacoast", F.coalesce(text("nonpay").try_cast("int"), F.lit(0))).otherwise(0)
    free = F.when(cap.isNotNull() & taken.isNotNull(), F.when(full.isNotNull(), 0).otherwise(F.greatest(F.lit(0), cap - taken)))
    label = text("_yearLabel")
    words = term(label, r"(\d{3})", SEASON_WORDS)
    nth = F.coalesce(group(label, r"第\s*([1-4一二三四])\s*學期"), group(label, r"-\s*([1-4])"))
    words["term.season"] = F.when(words["term.year"].isNotNull(), F.coalesce(words["term.season"], code_map(nth, {"1": "spring", "一": "spring", "2": "autumn", "二": "autumn"})))
    district, place, topics = code_map(tai(text("p_area")), {t[:-1]: t for t in TOWNSHIPS}), text("place_name"), F.filter(F.transform(F.split(blank("label_name"), "[,，]"), trim_all), lambda x: x != "")
    return course(raw.where(text("c_sn").isNotNull() & text("c_name").isNotNull()), "yunlin-cc", F.concat_ws(":", "_school", text("c_sn")), fetched_at, {
        "title": text("c_name"), "provider.nameRaw": text("_schoolName"), "provider.kind": F.lit("community-college"), "externalIds.schoolCourseCode": text("c_sn"),
        "schedule.recurrence": F.lit("weekly"), "schedule.slots": some_slots(F.when(F.coalesce(day.cast("string"), clock("c_StartTime"), clock("c_EndTime")).isNotNull(), slot(day, clock("c_StartTime"), clock("c_EndTime")))), "schedule.startDate": group(text("c_StartDate"), r"^(\d{4}-\d{2}-\d{2})$"),
        "enrollment.status": F.when(full.isNotNull() | F.coalesce(free == 0, F.lit(False)), "full").otherwise("unknown"), "enrollment.statusRaw": F.nullif(F.concat_ws("／", full, text("c_state")), F.lit("")),
        "enrollment.capacity": cap, "enrollment.enrolled": taken, "enrollment.available": free, "teachers": teacher(text("teacher_name")), "categoryRaw": text("ct_name"), "topicsRaw": F.when(F.size(topics) > 0, topics),
        "location.city": F.lit("雲林縣"), "location.district": district, "location.venueNameRaw": place, "location.addressPrecision": F.when(place.isNotNull(), "venue-name-only").when(district.isNotNull(), "district").otherwise("city"),
        "sourceUrl": text("_detailUrl"), **words,
    })


NORMALIZERS: dict[str, Callable[..., DataFrame]] = {
    "moe-cc-detail": college_details,
    "taipei-cc": city_courses,
    "cc-shared-platform": shared_platform,
    "ntpc-cc": new_city_courses,
    "ntpc-ezlearn": learning_network,
    "taoyuan-cc-portal": taoyuan_portal,
    "tainan-cc-portal": tainan_portal,
    "nantou-cc-portal": nantou_portal,
    "penghu-cc-portal": penghu_portal,
    "yunlin-cc": yunlin_portal,
}
