"""Schemas and enumerations of listings, observations, venues and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT = "struct<weekday:int,startTime:string,endTime:string>"

COURSE = (
    "_source string, _sourceRecordId string, _fetchedAt string, sourceUrl string, sourceUpdatedAt string, "
    "externalIds struct<schoolCourseCode:string,centerCourseCode:string,taiwanjobs:string,forestCourseCode:string>, "
    "title string, titleNormalized string, description string, categoryRaw string, audienceRaw string, topicsRaw array<string>, "
    "teachers array<struct<nameRaw:string>>, credit double, courseCodeRaw string, courseTypeRaw string, "
    "provider struct<nameRaw:string,kind:string,operatorRaw:string,planRaw:string,campusRaw:string,phoneRaw:string>, "
    "term struct<raw:string,year:int,season:string,termNo:int>, "
    f"schedule struct<startDate:string,endDate:string,recurrence:string,sessionsPerWeek:int,sessions:int,weeks:int,hours:double,slots:array<{SLOT}>,timeInfoRaw:string>, "
    "enrollment struct<status:string,statusRaw:string,opensAt:string,closesAt:string,closesRuleRaw:string,capacity:int,available:int,enrolled:int,"
    "registerUrl:string,noteRaw:string,openFlagRaw:string,reviewStatusRaw:string>, "
    "isFree boolean, price double, priceText string, "
    "location struct<venueNameRaw:string,address:string,addressPrecision:string,city:string,district:string,lat:double,lng:double,geocodeSource:string>"
)

VENUE = (
    "_source string, _sourceRecordId string, _fetchedAt string, name string, kindRaw string, city string, district string, address string, "
    "lat double, lng double, phone string, website string, facilities array<string>, usedByRaw array<string>, latestYear string, description string"
)

OBSERVATION = "id string, sourceRecordId string, entityKind string, contentHash string, firstObservedAt string, lastVerifiedAt string, lastChangedAt string, disappearedAt string, sourceUpdatedAt string"
RELATION = "fromKind string, fromId string, predicate string, toKind string, toId string, toNameRaw string, state string, method string, confidence double, updatedAt string"

#: The enumerations.
STATUSES = ("open", "upcoming", "full", "running", "closed", "cancelled", "unknown")
RECURRENCES = ("weekly", "biweekly", "twice-weekly", "biweekly-twice", "irregular", "single")
SEASONS = ("spring", "summer", "autumn", "winter")
PRECISIONS = ("street", "district", "city", "venue-name-only", "none")
KINDS = ("community-college", "sports-center", "senior-center", "library", "vocational", "adult-education", "school-continuing", "women-center", "other")


def known(col: Column, values: tuple[str, ...]) -> Column:
    """Whether a value is one of an enumeration, or missing."""
    return col.isNull() | col.isin(*values)


def violations(courses: DataFrame) -> DataFrame:
    """(_source, _sourceRecordId, field, value) of every value outside its enumeration."""
    checks = (("enrollment.status", STATUSES), ("schedule.recurrence", RECURRENCES), ("term.season", SEASONS), ("location.addressPrecision", PRECISIONS), ("provider.kind", KINDS))
    bad = F.array(*[F.when(~known(F.col(c), v), F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))) for c, v in checks])
    return courses.select("_source", "_sourceRecordId", F.explode(F.array_compact(bad)).alias("v")).select("_source", "_sourceRecordId", "v.field", "v.value")
