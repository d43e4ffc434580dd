import random

import pytest
from pyspark.sql import functions as F

from weftline import schema
from weftline.operators import aggregates as A
from weftline.operators import joins as J
from weftline.operators import observe as O
from weftline.operators import quality as Q
from weftline.operators import resolve as R
from weftline.operators import slugs as S
from weftline.operators import windows as W

OBS = "id string, source string, school string, title string, code string, term_year int, term_season string, term_raw string, teacher string, weekday int, start string"


def clusters(spark, rows):
    out = {}
    for r in R.cluster_greedy(spark.createDataFrame(rows, OBS)).collect():
        out.setdefault(r.cluster, set()).add(r.id)
    return sorted(map(sorted, out.values()))


ROWS = [
    ("a1", "s1", "臺北市文山社區大學", "書法", "C1", 115, "spring", None, "王", 1, "19:00"),
    ("a2", "s2", "台北市文山社大", "書法", "C1", 115, "spring", None, "王", 1, "19:00"),
    ("a3", "s1", "臺北市文山社區大學", "書法", "C1", 115, "autumn", None, "王", 1, "19:00"),
    ("a4", "s3", "文山社大", "書法", "C1", None, None, None, "王", 1, "19:00"),
    ("b1", "s1", "", "書法", None, None, None, None, None, None, None),
    ("b2", "s1", None, "書法", None, None, None, None, None, None, None),
]


def test_terms_stay_apart_and_are_not_bridged(spark):
    got = clusters(spark, ROWS)
    assert ["a1", "a2", "a4"] in got and ["a3"] in got
    assert ["b1"] in got and ["b2"] in got


def test_weak_rules_need_term_and_time(spark):
    base = ("甲社大", "瑜珈", None)
    rows = [
        ("a1", "s1", *base, 115, "春", None, "李", 2, "09:00"),
        ("a2", "s2", *base, 115, "春", None, "李", 2, "10:00"),  # another class of the same teacher
        ("a3", "s3", *base, 115, "春", None, "李", 3, None),
        ("a4", "s4", *base, 115, "春", None, "李", 3, None),  # no time known: weekday and term decide
        ("a5", "s5", *base, 115, "秋", None, "李", 3, None),
        ("a6", "s4", *base, 115, "春", None, "李", 3, None),  # meets a3 of another source
        ("a7", "s3", *base, 115, "春", None, "李", 3, None),  # meets a3 of its own source, both without codes
        ("a8", "s6", *base, None, None, None, "李", 2, "09:00"),  # without a term titles do not meet
    ]
    got = {r.id: (r.root, r.rule) for r in R.cluster_greedy(spark.createDataFrame(rows, OBS)).collect()}
    assert [sorted(i for i in got if got[i][0] == root) for root in sorted({v[0] for v in got.values()})] == [["a1"], ["a2"], ["a3", "a4", "a6"], ["a5"], ["a7"], ["a8"]]
    assert got["a3"][1] == got["a4"][1] == "title-teacher" and got["a1"][1] == "singleton"


def test_greedy_clusters_equal_a_walk_over_all_orders(spark):
    from weftline.plans.matching import order_listings

    keyed = R.blocking_keys(order_listings(spark, "/root/testdata/sf0.001")).select("id", "source", "code", "fixed_term", "keys").collect()
    up, term, owner, sure = {r.id: r.id for r in keyed}, {r.id: r.fixed_term for r in keyed}, {}, {}
    rows = {r.id: r for r in keyed}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in sorted(keyed, key=lambda r: r.id):
        for k in r.keys:
            if k.key not in owner:
                owner[k.key] = r.id
                continue
            o = rows[owner[k.key]]
            a, b = find(o.id), find(r.id)
            if k.confidence < 1:
                if o.source == r.source and o.code and r.code and o.code != r.code:
                    continue
                if term[a] and term[b] and term[a] != term[b]:
                    continue
                if k.confidence <= 0.85 and o.source == r.source and not o.code and not r.code:
                    continue
            t = term[a] or term[b]
            up[max(a, b)] = min(a, b)
            term[min(a, b)] = t
            for x in (o.id, r.id):
                if sure.get(x, (0, ""))[0] < k.confidence:
                    sure[x] = (k.confidence, k.rule)
    got = {r.id: (r.root, r.rule, r.confidence) for r in R.cluster_greedy(order_listings(spark, "/root/testdata/sf0.001")).collect()}
    assert got == {i: (find(i), *(sure.get(i, (1.0, "singleton"))[::-1])) for i in up}
    assert len({v[0] for v in got.values()}) < len(got) and {v[1] for v in got.values()} >= {"school-course-code", "title-slot", "singleton"}


def random_listings(seed, n=260):
    """Few values, so keys are shared widely; raw terms that read like year and season cross terms."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        year, season = rng.choice([(115, "春"), (115, "秋"), (None, None), (115, None)])
        raw = rng.choice([None, "115春", "115秋", "115 春"])
        out.append((f"r{k:04}", rng.choice("st"), rng.choice(["甲社大", "乙社大"]), rng.choice("畫琴"), rng.choice([None, "A", "B"]), year, season, raw, rng.choice([None, "王"]), rng.choice([None, 1, 2]), rng.choice([None, "09:00"])))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_kinds_end_where_their_first_row_ends(spark, seed):
    df = spark.createDataFrame(random_listings(seed), OBS)
    want = R.greedy_merge(R.blocking_keys(df).select("id", "source", "code", "fixed_term", "keys").toPandas())
    got = R.cluster_greedy(df).toPandas().sort_values("id").reset_index(drop=True)
    assert got[["id", "cluster", "root", "rule", "confidence"]].equals(want)


def test_terms_that_cross_are_merged_row_by_row():
    links = [[], [(0, "title-slot", 0.9)], [], [(2, "school-course-code", 1.0), (0, "title-slot", 0.9)], [(2, "school-course-code", 1.0)]]
    roots, _, crossed = R.greedy(list("abcde"), [None] * 5, ["x", None, "y", "x", "x"], links)
    assert roots == [0, 0, 2, 2, 2] and crossed == [3, 4]


def test_one_hot_key_makes_few_kinds(spark):
    rows = [(f"h{k:06}", f"s{k % 5}", "甲社大", "瑜珈", None, 115, "春", None, "李", 2, "09:00") for k in range(3000)]
    got = R.cluster_greedy(spark.createDataFrame(rows, OBS)).collect()
    want = R.greedy_merge(R.blocking_keys(spark.createDataFrame(rows, OBS)).select("id", "source", "code", "fixed_term", "keys").toPandas())
    assert {(r.id, r.root) for r in got} == set(zip(want["id"], want["root"], strict=True))


def test_clusters_do_not_depend_on_row_order(spark):
    rows = list(ROWS)
    want = clusters(spark, rows)
    random.Random(1).shuffle(rows)
    assert clusters(spark, rows) == want


def test_same_source_codes_veto(spark):
    rows = [("x1", "s1", "甲社大", "瑜珈", "A", 115, "春", None, "李", 2, "09:00"), ("x2", "s1", "甲社大", "瑜珈", "B", 115, "春", None, "李", 2, "09:00"), ("x3", "s2", "甲社大", "瑜珈", "Z", 115, "春", None, "李", 2, "09:00")]
    assert clusters(spark, rows) == [["x1", "x3"], ["x2"]]


def test_merge_is_stable_and_reappearance_clears(spark):
    kind = "id long, payload string, content_hash string"
    new = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2x"), (4, "d", "h4")], kind)
    old = spark.createDataFrame([(1, "a", "h1", "d0", "d1", "d1", "d1"), (2, "b", "h2", "d0", "d1", "d1", None), (3, "c", "h3", "d0", "d1", "d1", None)], kind + ", first_observed string, last_verified string, last_changed string, disappeared string")
    out = {r.id: r for r in O.snapshot_merge(new, old, "id", F.lit("d2")).collect()}
    assert {k: r.change for k, r in out.items()} == {1: "verified", 2: "changed", 3: "disappeared", 4: "added"}
    assert out[1].disappeared is None and out[3].disappeared == "d2" and out[2].last_changed == "d2" and out[1].last_changed == "d1"
    again = O.snapshot_merge(new, spark.createDataFrame(list(out.values())).drop("change"), "id", F.lit("d3"))
    assert {r.change for r in again.where("id <> 3").collect()} == {"verified"}


def test_schedule_state(spark):
    state = spark.createDataFrame([("a", "h", 86_400_000, 9, 0), ("b", "h", 86_400_000, 0, 1), ("c", "h", 86_400_000, 3, 0)], "source string, content_hash string, interval_ms long, unchanged long, failures long")
    run = spark.createDataFrame([("a", 0, "h", False), ("b", 0, None, True), ("c", 0, "x", False)], "source string, at_ms long, new_hash string, failed boolean")
    got = {r.source: r for r in O.next_state(state, run).collect()}
    assert (got["a"].interval_ms, got["a"].unchanged) == (129_600_000, 10)
    assert (got["b"].interval_ms, got["b"].failures, got["b"].content_hash) == (86_400_000, 2, "h")
    assert (got["c"].interval_ms, got["c"].unchanged, got["c"].content_hash) == (43_200_000, 0, "x")


def test_slugs_never_change_and_grow_on_collision(spark):
    items = spark.createDataFrame([(str(k), "x") for k in range(50)], "id string, base string")
    ledger = S.assign_slugs(items.where("id < '3'"), spark.createDataFrame([], "id string, slug string")).select("id", "slug")
    more = S.assign_slugs(items, ledger)
    assert more.join(ledger, "id").count() == 0
    every = [r.slug for r in ledger.collect()] + [r.slug for r in more.collect()]
    assert len(set(every)) == 50
    h = spark.range(1).select(F.sha2(F.lit("7"), 256)).first()[0]
    taken = spark.createDataFrame([("other", "X-" + h[:5].upper())], "id string, slug string")
    got = S.assign_slugs(spark.createDataFrame([("7", "x")], "id string, base string"), taken).first()
    assert got.length == 6 and got.slug == "x-" + h[:6]


def test_venues(spark):
    reg = spark.createDataFrame([("v1", "c", "a1", "n1", None, None), ("v2", "c", "a2", "n1", 25.0, 121.0), ("v3", "d", "a3", "n3", None, None)], "venue_id string, city string, address_key string, name_key string, lat double, lng double")
    geo = spark.createDataFrame([("a9", 24.0, 120.0), ("a3", 23.0, 120.5)], "address_key string, lat double, lng double")
    courses = spark.createDataFrame([("k1", "c", "a1", "n1", None), ("k2", "d", "a3", "", None), ("k3", "c", "a9", "n3", None), ("k4", "c", "", "zz", None), ("k5", "c", "", "", None), ("k6", None, "", "n3", None)], "cluster string, city string, address_key string, venue_key string, provider_key string")
    got = {r.cluster: r for r in R.resolve_venues(courses, reg, geo).collect()}
    assert (got["k1"].venue_id, got["k1"].method) == ("v2", "registry-name")
    assert (got["k2"].venue_id, got["k2"].method, got["k2"].lat, got["k2"].confidence) == ("v3", "registry-address", 23.0, 0.95)
    assert (got["k3"].method, got["k3"].confidence) == ("geocoded-address", 0.95)
    assert (got["k4"].method, got["k5"].method, got["k5"].venue_id) == ("derived-name", "none", None)
    assert got["k6"].venue_id == "v3"
    rows = R.venue_rows(R.resolve_venues(courses, reg, geo), courses.select("cluster", "city"))
    assert {r.venue_id: r.course_count for r in rows.collect()}["v3"] == 2


def test_venue_names_within_and_without_counties(spark):
    reg = spark.createDataFrame([("v1", "臺中市", "", "大里運動中心", 24.1, 120.6), ("v2", "高雄市", "", "高雄市小港館", None, None), ("v3", "臺南市", "b3", "田徑場", None, None)], "venue_id string, city string, address_key string, name_key string, lat double, lng double")
    geo = spark.createDataFrame([("b3", 23.0, 120.2), ("c1", 22.0, 121.1)], "address_key string, lat double, lng double")
    courses = spark.createDataFrame(
        [
            ("k1", "臺中市", "", "臺中市大里運動中心", None),  # found without its county
            ("k2", None, "", "小港館", None),  # the registry's name without its county
            ("k3", "臺東縣", "", "田徑場", None),  # same name, another county
            ("k4", "其他", "", "田徑場", None),  # no county, so the name counts; coordinates of the venue's own address
            ("k5", "臺南市", "c1", "田徑場", None),  # geocoded, and the registry row has no coordinates
            ("k6", "臺中市", "", "", "大里運動中心"),
        ],
        "cluster string, city string, address_key string, venue_key string, provider_key string",
    )
    got = {r.cluster: (r.venue_id, r.method, r.lat) for r in R.resolve_venues(courses, reg, geo).collect()}
    assert got["k1"] == ("v1", "registry-name", 24.1) and got["k6"] == got["k1"] and got["k2"] == ("v2", "registry-name", None)
    assert got["k3"][1:] == ("derived-name", None) and got["k4"] == ("v3", "registry-name", 23.0) and got["k5"][1:] == ("geocoded-address", 22.0)


def test_ties_and_thresholds(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, None)], "k int, v string")
    assert {r.k: r.m for r in A.mode_tie(df, ["k"], "v", "m").collect()} == {1: "b", 2: "c"}
    loc = spark.createDataFrame([(1, 1, ("district", "", "d", "c")), (1, 2, ("street", "x", "", "")), (1, 3, ("street", "x", "", ""))], "k int, o int, location struct<addressPrecision:string,address:string,district:string,city:string>")
    assert A.best_location(loc, "k", "o").first().location.addressPrecision == "street"


def test_joins(spark):
    df = spark.createDataFrame([(1, "市立圖書館"), (2, "圖書館"), (3, "x")], "id int, t string")
    dim = spark.createDataFrame([(1, "館"), (2, "圖書館")], "o int, name string")
    got = {r.id: r.o for r in J.suffix_join(df, "id", "t", dim, "name", "o", ["o"]).collect()}
    assert got == {1: 1, 2: 2, 3: None}
    a, b = spark.createDataFrame([(1, "p"), (2, "q")], "k int, x string"), spark.createDataFrame([(1, "")], "k int, x string")
    assert {r.k: r.x for r in J.override(a, b, "k").collect()} == {1: "", 2: ""}


def test_chunks_and_caps(spark):
    df = spark.createDataFrame([(k,) for k in range(25)], "k int")
    one = {r.k: r.c for r in W.chunk_ids(df, [F.col("k")], 10, "c").collect()}
    assert one == {k: k // 10 + 1 for k in range(25)}
    rows = spark.createDataFrame([(k, k % 2, k // 2) for k in range(12)], "k int, p int, t int")
    assert [r.k for r in W.capped_pick(rows, ["t"], ["p"], [F.col("k")], 2, 3).collect()] == [0, 2]


def test_validation(spark):
    row = ("", [8], "25:00", "10:00", "2026-01-01", "2026-03-01", 99, -1.0)
    df = spark.createDataFrame([row], "title string, weekdays array<int>, start_time string, end_time string, start_date string, end_date string, sessions int, price double")
    assert df.select(Q.reasons(Q.timetable_checks(F.lit("2026-01-05"))).alias("r")).first().r == ["title", "weekdays", "time", "length", "sessions", "price"]
    bad = schema.violations(spark.createDataFrame([("s", "1", ("maybe",), ("weekly",), ("spring",), ("street",), ("library",))], "_source string, _sourceRecordId string, enrollment struct<status:string>, schedule struct<recurrence:string>, term struct<season:string>, location struct<addressPrecision:string>, provider struct<kind:string>"))
    assert [(r.field, r.value) for r in bad.collect()] == [("enrollment.status", "maybe")]
    with pytest.raises(Exception, match="no slug"):
        Q.require(spark.range(1), F.lit(False), "no slug").collect()


def test_projection_and_people(spark):
    from weftline.operators import project as P

    m = spark.createDataFrame([("c", "s1", "r1", 0.9, 1, None, 5), ("c", "s2", "r2", 1.0, 2, "x", None), ("c", "s3", "r3", 0.9, 3, "y", 6)], "k string, src string, rec string, conf double, prio int, a string, b int")
    r = P.project(m, "k", ["a", "b"], "src", "rec", "conf", "prio").first()
    assert (r.a, r.b) == ("x", 5) and [s.source for s in r.sources] == ["s2", "s1", "s3"]
    assert [(x.field, x.value, x.source) for x in r.rejected] == [("a", "y", "s3"), ("b", "6", "s3")]
    df = spark.createDataFrame([(1, "王小明老師、李四（阿四）", "甲"), (2, "王小明", "甲"), (3, "王小明", "乙"), (4, "王小明/專業師資", "乙"), (5, None, "乙")], "id int, t string, p string")
    people = P.teachers(df, "id", "t", "p")
    assert sorted((x.name, x.p, x.courses) for x in people.collect()) == [("王小明", "乙", [3, 4]), ("王小明", "甲", [1, 2])]
    assert P.same_name(people, "p").count() == 2
    got = P.categorised(df, F.lit("k"), F.col("t"), {"z": "Z"}, [("李", "L")]).orderBy("id").first()
    assert (got.category, got.categoryFrom) == ("L", "title")


def test_tiers_are_taken_from_lists_not_from_joined_candidates(spark):
    rows = [(k, k % 2 or None, k % 3, (k * 7) % 5) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, a int, b int, price int")
    found = J.tiered_fill(df, "id", [["a", "b"], ["a"], ["b"]], ["price"], 4)
    want = set()
    for i, a, b, _ in rows:
        tier = lambda o: 0 if a and (o[1], o[2]) == (a, b) else 1 if a and o[1] == a else 2 if o[2] == b else None  # noqa: B023, E731
        best = sorted((tier(o), o[3], o[0]) for o in rows if o[0] != i and tier(o) is not None)[:4]
        want |= {(i, o, t, n + 1) for n, (t, _, o) in enumerate(best)}
    assert {tuple(r) for r in found.collect()} == want
    assert "Aggregate [id" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_read_by_columns_and_keys_meet_as_hashes(spark, monkeypatch):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("pos", pa.int32()), ("owner", pa.string()), ("rule", pa.string()), ("confidence", pa.float64())]))
    link = lambda owner, sure: {"pos": 0, "owner": owner, "rule": f"r{sure}", "confidence": sure}
    links = [[link("q", 1.0)], [link(None, 1.0)], [], [link("b", 0.9), link(None, 0.8), link("a", 0.8)], [link("d", 1.0)]]
    rows = pa.table({"id": list("pabde"), "links": pa.array(links, kind)})
    assert R._links(rows.slice(1)) == [[], [], [(1, "r0.9", 0.9), (0, "r0.8", 0.8)], [(2, "r1.0", 1.0)]]
    with pytest.raises(ValueError, match="outside"):
        R._links(rows)
    made, cut = {}, R.cut
    monkeypatch.setattr(R, "cut", lambda df, label: made.setdefault(label, cut(df, label)))
    R.cluster_greedy(spark.createDataFrame(ROWS, OBS))
    assert dict(made["owners"].dtypes)["key"] == "binary" and {len(r.key) for r in made["owners"].collect()} == {16}
