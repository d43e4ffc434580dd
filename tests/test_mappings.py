"""Hand-written records of the portal, library and training mappings."""

import pytest

from weftline.schema import COURSE, violations
from weftline.sources import events as E
from weftline.sources import normalize as N
from weftline.sources import portals as P
from weftline.sources.catalogue import NORMALIZERS

AT = "2026-09-13T08:00:00+08:00"


def table(spark, columns, *rows):
    """Rows given as dicts; columns as "a b c:array<string>", text unless said otherwise."""
    fields = [c.split(":", 1) if ":" in c else (c, "string") for c in columns.split(" ")]
    schema = ", ".join(f"`{n}` {t}" for n, t in fields)
    return spark.createDataFrame([tuple(r.get(n) for n, _ in fields) for r in rows], schema)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    assert violations(df).count() == 0 if "enrollment" in df.columns else True
    return rows[0]


def slots(r):
    return [(s.weekday, s.startTime, s.endTime) for s in r.schedule.slots]


def test_every_source_has_a_mapping():
    assert len(NORMALIZERS) == 32


DETAIL = "course_id course_name school_name school_id address price quarter time_cat_id weekday time_begin time_end weekday_2 time_2_begin time_2_end course_tag_id_arr date_begin date_end time_info teach_status teacher_name credit course_url internal_course_code course_intro"


def test_college_details(spark):
    row = {"course_id": "7", "course_name": " 書法 ", "school_name": "文山社大", "address": "景中街27號", "price": "0", "quarter": "1152", "time_cat_id": "12", "weekday": "0", "time_begin": "19:00:00", "time_end": "21:00:00", "weekday_2": "3", "time_2_begin": "09:00:00", "time_2_end": "10:00:00", "course_tag_id_arr": "1;99;4", "date_begin": "2026-09-01", "date_end": "0000-00-00", "teach_status": "1", "course_intro": '"說明"', "internal_course_code": "A1"}
    r = one(P.college_details(table(spark, DETAIL, row, {"course_name": "x"}), AT))
    assert (r._source, r._sourceRecordId, r.description, r.externalIds.schoolCourseCode, r.location.city) == ("moe-cc-detail", "7", "說明", "A1", None)
    assert slots(r) == [(7, "19:00", "21:00"), (3, "09:00", "10:00")] and r.topicsRaw == ["性別平等", "環境永續"] and r.schedule.endDate is None and r.isFree


CITY = "_id name school cg classTime dayInWeekId:array<string> address district code classLink modifiedAt requirement lcg teacher startDate endDate semester openStatus tuition comment"


def test_city_courses(spark):
    rows = [
        {"_id": "1", "name": "瑜珈", "cg": "樂齡學堂", "classTime": "9:00-11:30", "dayInWeekId": ["1", "3", "9"], "address": "景中街二十七號", "district": "文山區", "startDate": "2026-09-01T00:00", "endDate": "1911-01-01", "semester": "115年秋季班", "openStatus": "額滿", "tuition": "1500"},
        {"_id": "2", "name": "太極", "classTime": "0900-1130", "dayInWeekId": None, "address": "活動中心", "tuition": "依公告", "openStatus": "?"},
        {"_id": None, "name": "x"},
        {"_id": "3", "name": "插花", "classTime": "晚上", "dayInWeekId": ["7"], "district": "大安區", "tuition": "", "semester": "寒假班"},
    ]
    got = {r._sourceRecordId: r for r in P.city_courses(table(spark, CITY, *rows), AT).collect()}
    a, b, c = got["1"], got["2"], got["3"]
    assert slots(a) == [(1, "09:00", "11:30"), (3, "09:00", "11:30")] and a.schedule.recurrence == "twice-weekly" and (a.schedule.startDate, a.schedule.endDate) == ("2026-09-01", None)
    assert (a.location.address, a.location.addressPrecision, a.provider.kind, a.enrollment.status, a.price, a.isFree, a.term.year, a.term.season) == ("臺北市文山區景中街二十七號", "street", "senior-center", "full", 1500.0, False, 115, "autumn")
    assert slots(b) == [(None, "09:00", "11:30")] and (b.price, b.priceText, b.location.addressPrecision, b.provider.kind, b.enrollment.status) == (None, "依公告", "venue-name-only", "other", "unknown")
    assert slots(c) == [(7, None, None)] and (c.location.addressPrecision, c.isFree, c.term.season, c.term.year) == ("district", None, "winter", None)


def test_shared_platform(spark):
    cols = "host courseHash title weekdayText timeBegin timeEnd statusText openFlag schoolName schoolLine startDate timeOfDay capacityText teacher courseCode termText addressText areaText note url"
    rows = [{"host": "h", "courseHash": "c", "title": "陶藝", "weekdayText": "六", "timeBegin": "09:00", "statusText": "已額滿", "openFlag": "熱門", "capacityText": "限 25 人", "termText": " 115 秋季班", "addressText": "台中市西屯區安和路3號"}, {"host": "h", "courseHash": "d", "title": "茶", "areaText": "山線", "openFlag": "", "termText": "秋季"}]
    got = {r._sourceRecordId: r for r in P.shared_platform(table(spark, cols, *rows), AT).collect()}
    a, b = got["h:c"], got["h:d"]
    assert slots(a) == [(6, "09:00", None)] and (a.enrollment.status, a.enrollment.capacity, a.enrollment.openFlagRaw, a.term.season, a.location.city, a.location.district, a.location.addressPrecision) == ("full", 25, "熱門", "autumn", "臺中市", "西屯區", "street")
    assert slots(b) == [] and (b.provider.nameRaw, b.location.venueNameRaw, b.location.addressPrecision, b.term.year, b.enrollment.openFlagRaw) == ("h", "山線", "venue-name-only", None, None)


def test_new_city(spark):
    cols = "classId 課程名稱 授課社大 授課星期 開課狀況 開課日期 行政區 課程類別 授課教師 detailPath"
    r = one(P.new_city_courses(table(spark, cols, {"classId": "5", "課程名稱": "【停開】吉他", "授課星期": "星期日", "開課狀況": "停課中", "開課日期": "2027-01-05", "detailPath": "d/5"}), AT))
    assert (r.titleNormalized, r.term.raw, r.term.year, r.term.season, r.enrollment.status, r.sourceUrl, r.location.addressPrecision) == ("吉他", "115寒", 115, "winter", "cancelled", "https://cci.ntpc.edu.tw/cht/d/5", "city") and slots(r) == [(7, None, None)]
    cols = "courseId title providerText registerRange areaText categoryText startDateText capacityText"
    r = one(P.learning_network(table(spark, cols, {"courseId": "9", "title": "棋", "providerText": "三重婦女中心", "registerRange": "2026-09-01 09:00 ~ 2026-09-20", "areaText": "三重區", "startDateText": "自 2026-10-01 起", "capacityText": "30人"}), AT))
    assert (r.provider.kind, r.enrollment.status, r.enrollment.opensAt, r.enrollment.closesAt, r.schedule.startDate, r.enrollment.capacity) == ("women-center", "open", "2026-09-01T09:00:00+08:00", "2026-09-20T00:00:00+08:00", "2026-10-01", 30)


def test_county_portals(spark):
    cols = "courseId courseName organizer weekdayText startDate timeOfDay categoryText courseTypeText semesterText discountText detailUrl"
    r = one(P.taoyuan_portal(table(spark, cols, {"courseId": "e", "courseName": "課", "weekdayText": "星期二", "startDate": "2026/09/01", "discountText": "🔥 優惠", "semesterText": "115年春季"}), AT))
    assert slots(r) == [(2, None, None)] and (r.topicsRaw, r.schedule.startDate, r.term.season, r.sourceUrl[-2:]) == (["優惠"], None, "spring", "=e")
    cols = "courseId title gridWeekdayText timeText dateText statusRaw schoolName termText teacherText roomText url"
    r = one(P.tainan_portal(table(spark, cols, {"courseId": "1", "title": "課", "gridWeekdayText": "星期四", "timeText": "00:00~00:00", "dateText": "2026-09-01 ~ 2026-12-01", "statusRaw": "停開", "termText": "115 年度 秋", "teacherText": "王、李 陳／", "roomText": "A1"}), AT))
    assert slots(r) == [(4, None, None)] and [t.nameRaw for t in r.teachers] == ["王", "李", "陳"] and (r.enrollment.status, r.term.raw, r.schedule.endDate, r.location.addressPrecision) == ("cancelled", "115年度秋", "2026-12-01", "venue-name-only")
    cols = "courseId detailTitle title timeText gridWeekdayText schoolName unitName campusName detailTermText termText weeksText hoursText periodText capacityText enrolledText remainingText fullFlag:boolean immediateText reviewStatusText categoryText groupText audienceText creditText outlineText goalText teacherText teacher feeText venueText classroom url"
    rows = [{"courseId": "1", "title": "課", "timeText": "星期一 9時0分 ~ 11時30分 星期三", "enrolledText": "12人", "remainingText": "8", "capacityText": "99", "termText": "115 年度春"}, {"courseId": "2", "title": "課", "gridWeekdayText": "星期五", "fullFlag": True, "remainingText": "3", "immediateText": "停開", "capacityText": "20", "feeText": "300"}]
    a, b = sorted(P.nantou_portal(table(spark, cols, *rows), AT).collect(), key=lambda r: r._sourceRecordId)
    assert slots(a) == [(1, "09:00", "11:30"), (3, None, None)] and (a.enrollment.capacity, a.enrollment.available, a.enrollment.status, a.schedule.sessionsPerWeek) == (20, 8, "open", 2)
    assert slots(b) == [(5, None, None)] and (b.enrollment.capacity, b.enrollment.available, b.enrollment.status, b.priceText) == (20, 0, "cancelled", "課程相關費用：300")
    cols = "courseId detailTitle titleText slotsText:array<struct<weekdayText:string,timeText:string>> termText detailTimeText codeText categoryText audienceText goalText teacherName teacherText materialFeeText venueText url updatedText"
    rows = [{"courseId": "1", "titleText": "課", "slotsText": [("週二", "9:00 ~ 10:30"), ("未定", "x"), ("星期六", None)], "venueText": "馬公市 中正路 7 號(二樓)", "detailTimeText": "共 36 小時"}, {"courseId": "2", "titleText": "課", "slotsText": None, "venueText": "湖西鄉活動中心", "detailTimeText": "另定"}]
    a, b = sorted(P.penghu_portal(table(spark, cols, *rows), AT).collect(), key=lambda r: r._sourceRecordId)
    assert slots(a) == [(2, "09:00", "10:30"), (6, None, None)] and (a.location.address, a.location.addressPrecision, a.schedule.hours) == ("澎湖縣馬公市中正路7號", "street", 36.0)
    assert (b.location.address, b.location.district, b.location.addressPrecision, b.schedule.timeInfoRaw) == (None, "湖西鄉", "district", "另定")
    cols = "c_sn c_name c_week c_StartTime c_EndTime full c_state _school _schoolName _detailUrl c_StartDate _yearLabel c_UpperLimit c_now nonpay teacher_name ct_name label_name p_area place_name"
    rows = [{"c_sn": "1", "c_name": "課", "c_week": "星期三", "_school": "seacoast", "_yearLabel": "115年度第二學期", "c_UpperLimit": "20", "c_now": "15", "nonpay": "5", "p_area": "台西", "label_name": "a，b,"}, {"c_sn": "1", "c_name": "課", "_school": "hill", "full": "額滿", "c_state": "未開課", "c_UpperLimit": "20", "c_now": "3", "_yearLabel": "115-1 秋"}]
    a, b = sorted(P.yunlin_portal(table(spark, cols, *rows), AT).collect(), key=lambda r: r._sourceRecordId, reverse=True)
    assert (a._sourceRecordId, a.enrollment.enrolled, a.enrollment.available, a.enrollment.status, a.term.season, a.location.district, a.topicsRaw) == ("seacoast:1", 20, 0, "full", "autumn", "臺西鄉", ["a", "b"])
    assert (b.enrollment.available, b.enrollment.status, b.enrollment.statusRaw, b.term.season, slots(b)) == (0, "full", "額滿／未開課", "autumn", [])


LIBRARIES = [
    ("新北市", [("新北市立圖書館", "板橋區貴興路139號", "板橋區", 25.0, 121.4), ("新北市立圖書館三重分館", "自強路1號", "三重區", None, None), ("新北市三峽北大分館", None, "三峽區", 24.9, 121.3), ("測試館", None, None, None, None)]),
    ("臺南市", [("臺南市臺江文化中心圖書館", "安昌街2號", "安南區", 23.0, 120.2), ("臺南市歸仁區圖書館", "中山路1號", "歸仁區", 23.0, 120.3)]),
]
NEST = "`縣市` string, `圖書館資訊` array<struct<Name:string,Address:string,Area:string,Latitude:double,Longitude:double,TEL:string,URL:string,Intro:string>>"


def libraries(spark):
    return spark.createDataFrame([(c, [(*x, None, None, "<p>a&amp;b</p> c") for x in ls]) for c, ls in LIBRARIES], NEST)


def test_library_register(spark):
    got = {r.name: r for r in E.public_libraries(libraries(spark), AT).collect()}
    assert len(got) == 5 and got["新北市立圖書館"].lat == 25.0 and got["新北市立圖書館三重分館"].lat is None and got["臺南市歸仁區圖書館"].description == "a&b c"


def test_new_city_library_events(spark):
    cols = "sessionId activityTitle sessionTitle activityDateText url quotaText stateText registerStartText registerEndText excerptText"
    rows = [
        {"activityTitle": "【三重分館】說故事", "sessionTitle": "上午場", "activityDateText": "2026-10-01  10:00", "quotaText": "20/20", "registerStartText": "2026-09-01 9:05"},
        {"sessionId": "s2", "activityTitle": "【三峽區北大分館】書展", "stateText": "開放報名"},
        {"sessionId": "s3", "activityTitle": "【總館/三重】開幕"},
        {"sessionId": "s4", "activityTitle": "【全市】好書交換"},
        {"sessionId": "s5", "activityTitle": "【烏來】走讀"},
        {"sessionId": "s6", "activityTitle": None},
    ]
    got = {r.title: r for r in E.new_city_libraries(table(spark, cols, *rows), libraries(spark), AT).collect()}
    a = got["【三重分館】說故事－上午場"]
    assert len(got) == 5 and len(a._sourceRecordId) == 16 and (a.provider.nameRaw, a.location.addressPrecision, a.location.lat, a.enrollment.available, a.enrollment.status, a.enrollment.opensAt, a.schedule.endDate) == ("新北市立圖書館三重分館", "street", None, 0, "full", "2026-09-01T09:05:00+08:00", "2026-10-01")
    assert got["【三峽區北大分館】書展"].location.venueNameRaw == "新北市三峽北大分館" and got["【三峽區北大分館】書展"].enrollment.status == "open" and got["【三峽區北大分館】書展"].location.addressPrecision == "venue-name-only"
    assert (got["【總館/三重】開幕"].location.lat, got["【總館/三重】開幕"].location.geocodeSource) == (25.0, "registry")
    assert (got["【全市】好書交換"].provider.nameRaw, got["【全市】好書交換"].location.addressPrecision, got["【全市】好書交換"].location.city) == ("新北市立圖書館全市", "none", None)
    assert (got["【烏來】走讀"].location.venueNameRaw, got["【烏來】走讀"].location.city, got["【烏來】走讀"].location.addressPrecision) == ("新北市立圖書館烏來", "新北市", "venue-name-only")


def test_national_library_events(spark):
    cols = "activityId title listActivityRangeText activityTimeText statusText registerTimeText url categoryText audienceText introText sessions:array<struct<remainingText:string,venueText:string>>"
    rows = [{"activityId": "1", "title": "講座&mdash;一", "listActivityRangeText": "115-9/3~115-9/5", "statusText": "尚未開始報名", "registerTimeText": "115/8/1 9:00~115/8/20 17:30", "sessions": [("12", " 2樓 ")]}, {"activityId": "2", "title": "展", "listActivityRangeText": "115/13/1", "sessions": [("1", "A"), ("2", "B"), ("3", "A")]}, {"activityId": "3", "title": "無場次", "sessions": None}]
    a, b, c = sorted(E.national_library_events(table(spark, cols, *rows), AT).collect(), key=lambda r: r._sourceRecordId)
    assert (a.title, a.schedule.startDate, a.schedule.endDate, a.enrollment.status, a.enrollment.opensAt, a.enrollment.closesAt, a.enrollment.available, a.location.venueNameRaw, a.schedule.recurrence) == ("講座—一", "2026-09-03", "2026-09-05", "upcoming", "2026-08-01T09:00:00+08:00", "2026-08-20T17:30:00+08:00", 12, "國立公共資訊圖書館2樓", "single")
    assert (b.schedule.startDate, b.enrollment.available, b.location.venueNameRaw, b.location.addressPrecision, b.schedule.sessions, b.schedule.recurrence) == (None, None, "A、B", "none", 3, "irregular")
    assert (c.schedule.sessions, c.location.venueNameRaw) == (None, None)


def test_tainan_library_events(spark):
    session = "array<struct<`場次名稱`:string,`活動時間`:string,`報名狀態`:string,`報名時間`:string,`可報名數`:string,`年齡限制`:string,`講師姓名`:string,`活動說明`:string,`是否收費`:string,`活動地點`:string>>"
    cols = "主活動資訊網址暨報名連結 主活動名稱 主辦單位 主活動主要說明 主活動主題 主活動對象 本活動內各場次資訊:" + session
    rows = [
        {"主活動資訊網址暨報名連結": "https://x/activity/z12ab/", "主活動名稱": "故事", "主辦單位": "台江文化中心圖書館", "主活動主要說明": "<p>一</p>二&nbsp;三", "主活動對象": "兒童", "本活動內各場次資訊": [("第一場", "2026/10/1 10:00 至 2026/10/3 12:00", "開放報名中", "2026/9/1 9:00 至 2026/9/30 17:00", "25", "6歲以上", "王", None, "否", "B1"), ("故事", "2026/13/1", None, None, "x", None, None, "說", "是", None)]},
        {"主活動資訊網址暨報名連結": "https://x/none", "主活動名稱": "無代碼", "本活動內各場次資訊": [tuple([None] * 10)]},
        {"主活動資訊網址暨報名連結": "https://x/z9/", "主活動名稱": "歸仁", "主辦單位": "歸仁區圖書館", "本活動內各場次資訊": [tuple([None] * 10)]},
    ]
    got = {r._sourceRecordId: r for r in E.tainan_library_events(table(spark, cols, *rows), libraries(spark), AT).collect()}
    a, b = got["z12ab#0"], got["z12ab#1"]
    assert set(got) == {"z12ab#0", "z12ab#1", "z9#0"} and got["z9#0"].location.district == "歸仁區"
    assert (a.title, a.schedule.recurrence, a.schedule.endDate, a.enrollment.status, a.enrollment.closesAt, a.enrollment.capacity, a.isFree, a.audienceRaw, a.description, a.location.venueNameRaw, a.location.lat) == ("故事－第一場", "irregular", "2026-10-03", "open", "2026-09-30T17:00:00+08:00", 25, True, "兒童；6歲以上", "一\n二 三", "台江文化中心圖書館 B1", 23.0)
    assert (b.title, b.schedule.startDate, b.isFree, b.description, b.enrollment.capacity) == ("故事", None, False, "說\n\n一\n二 三", None)


def test_calendar_training_and_timetables(spark):
    cols = "link title startdate enddate description type a10:updated"
    place = {"name": "國家圖書館", "address": "中山南路20號", "city": "臺北市", "district": "中正區"}
    raw = spark.createDataFrame([("https://n?SId=ab-1", "展", "2026-08-01", "2026-09-01", "時間 地點：臺南分館（臺南市新營區長榮路1號）", None, None), ("https://n/2", "講", "x", None, "地點：某處（沒有門牌的地方哦）", None, None), (None, "x", None, None, None, None, None)], "link string, title string, startdate string, enddate string, description string, type string, `a10:updated` string")
    a, b = sorted(E.library_calendar(raw, AT, place).collect(), key=lambda r: r._sourceRecordId)
    assert (a._sourceRecordId, a.enrollment.status, a.location.venueNameRaw, a.location.city, a.location.district) == ("ab-1", "closed", "臺南分館", "臺南市", "新營區")
    assert (b._sourceRecordId, b.enrollment.status, b.location.address, b.location.city) == ("https://n/2", "unknown", "中山南路20號", "臺北市")
    cols = "課程代碼 課程名稱 辦理單位 開訓日期 結訓日期 報名開始日 報名結束日 訓練地點 期別 訓練時數 訓練時段 負擔費用 課程內容"
    r = one(E.on_the_job_training(table(spark, cols, {"課程代碼": "a/1", "課程名稱": "焊接", "開訓日期": "20261001", "結訓日期": "2026-1", "報名開始日": "20260901", "報名結束日": "20260920", "期別": "02", "負擔費用": "政府負擔:80 學員負擔:20", "課程內容": "一&amp;二^ ^三\t四"}), AT))
    assert (r.sourceUrl[-5:], r.schedule.startDate, r.schedule.endDate, r.enrollment.status, r.term.termNo, r.price, r.isFree, r.description) == ("a%2F1", "2026-10-01", None, "open", 2, 20.0, False, "一&二\n三 四")
    centers = spark.createDataFrame([("c1", "泰山中心", "新北市泰山區公園路1號", "某公司")], "_center string, name string, address string, operator string")
    cols = "_center title weekdays:array<int> startTime endTime code startDate endDate _periodStartMonth _docKey sessions price teacher note place category section audience _docUrl"
    rows = [{"_center": "c1", "title": "有氧", "weekdays": [1, 3], "startTime": "09:00", "_periodStartMonth": "2026-09", "price": "0", "sessions": "8", "teacher": "專業師資"}, {"_center": "c1", "title": "有氧", "weekdays": [1, 3], "startTime": "09:00", "_periodStartMonth": "2026-09", "price": "5"}, {"_center": "zz", "title": "無館", "weekdays": [1], "startTime": "09:00"}]
    r = one(E.timetable_images(table(spark, cols, *rows).coalesce(1), centers, AT))
    assert (r._sourceRecordId, r.isFree, r.price, r.priceText, r.teachers, r.term.raw, r.location.district, r.schedule.timeInfoRaw) == ("c1:2026-09:有氧|13|09:00", True, None, "0 元／8 堂", None, "11505", "泰山區", "共 8 堂") and slots(r) == [(1, "09:00", None), (3, "09:00", None)]


@pytest.mark.parametrize("make", [P.city_courses, P.yunlin_portal])
def test_empty_tables_and_nulls(spark, make):
    cols = CITY if make is P.city_courses else "c_sn c_name c_week c_StartTime c_EndTime full c_state _school _schoolName _detailUrl c_StartDate _yearLabel c_UpperLimit c_now nonpay teacher_name ct_name label_name p_area place_name"
    key = {"_id": "1", "name": "x"} if make is P.city_courses else {"c_sn": "1", "c_name": "x", "_school": "s"}
    assert make(table(spark, cols, key).where("false"), AT).count() == 0
    r = one(make(table(spark, cols, key), AT))
    assert r.title == "x" and slots(r) == [] and r.enrollment.status == "unknown" and r.price is None


def test_end_before_start_is_no_end(spark):
    rows = [{"_id": "1", "name": "x", "startDate": "2026-09-10", "endDate": "2026-03-01"}, {"_id": "2", "name": "y", "startDate": "2026-03-01", "endDate": "2026-09-10"}]
    got = N.drop_inverted(P.city_courses(table(spark, CITY, *rows), AT)).orderBy("_sourceRecordId").collect()
    assert [r.schedule.endDate for r in got] == [None, "2026-09-10"] and "struct" in COURSE
