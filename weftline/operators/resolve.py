"""Entity resolution: blocking keys, greedy merging with vetoes, venue relations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import county_of, hash8, norm_school, norm_title, term_key, without_county
from .graph import components
from .lineage import cut
from .skew import hot_keys, spread_join

#: Rules by falling confidence.
RULES = (("school-course-code", 1.0), ("school-course-code-noterm", 0.95), ("title-slot", 0.9), ("title-teacher-slot", 0.85), ("title-teacher", 0.8))
WEAK = 0.85


def blocking_keys(obs: DataFrame) -> DataFrame:
    """``obs`` with its normalised fields and ``keys``: array of (key, rule, confidence).

    Needs id, source, school, title, code, term_year, term_season, term_raw, teacher,
    weekday, start.  Every key begins with the school; without a school there are none.
    Codes may meet without a term; titles need one, and a starting time or a teacher.
    Classes of one teacher keep apart by their starting time, or by their weekday where
    no time is known.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    year, season = text("term_year"), text("term_season")
    o = obs.withColumns(
        {
            "school_key": norm_school(F.col("school")),
            "title_key": norm_title(F.col("title")),
            "teacher_key": norm_title(F.col("teacher")),
            "term": term_key(F.col("term_year"), F.col("term_season"), F.col("term_raw")),
            "fixed_term": F.when((year != "") & (year != "0") & (season != ""), F.concat(year, season)),
        }
    )

    def key(rule: int, needs: list[Column], *parts: Column) -> Column:
        ok = F.col("school_key") != ""
        for n in needs:
            ok = ok & (n != "")
        name, confidence = RULES[rule]
        return F.when(ok, F.struct(F.concat_ws("\x1f", F.lit(name), "school_key", *parts).alias("key"), F.lit(name).alias("rule"), F.lit(confidence).alias("confidence")))

    code, term, title, teacher, day, start = text("code"), F.col("term"), F.col("title_key"), F.col("teacher_key"), text("weekday"), text("start")
    keys = F.array(
        key(0, [code, term], term, code),
        key(1, [code], code),
        key(2, [term, title, day, start], term, title, day, start),
        key(3, [term, title, teacher, start], term, title, teacher, day, start),
        F.when(start == "", key(4, [term, title, teacher], term, title, teacher, day)),
    )
    return o.withColumn("keys", F.filter(keys, lambda k: k.isNotNull()))


class _Group:
    __slots__ = ("rows", "term")

    def __init__(self, row: int, term: str | None):
        self.rows, self.term = [row], term


def greedy(sources: list, codes: list, terms: list, links: list[list[tuple[int, str, float]]]) -> tuple[list[int], list[tuple[float, str]], list[int]]:
    """Each row's first group member, its best (confidence, rule), and rows that joined two different terms.

    Rows come in order; ``links`` are, in order, (owner, rule, confidence) of each row's
    keys, an owner being the first row that shows the key.  A row joins the owner's group
    unless the key is vetoed: owner and row come from one source with different codes;
    both groups have a year and season and they differ; or the rule is weak and both come
    from one source without a code.  The strongest rule is never vetoed.  A group's term
    is the owner's, or else the row's, so a row without one cannot bridge two terms.
    """
    group = [_Group(i, t or None) for i, t in enumerate(terms)]
    best: list[tuple[float, str]] = [(0.0, "")] * len(terms)
    crossed = []
    for i, mine_links in enumerate(links):
        for j, rule, sure in mine_links:
            first, mine = group[j], group[i]
            apart = bool(first.term and mine.term and first.term != mine.term)
            if sure < 1:
                alike = sources[i] == sources[j]
                if apart or (alike and codes[i] and codes[j] and codes[i] != codes[j]) or (sure <= WEAK and alike and not codes[i] and not codes[j]):
                    continue
            elif apart and first is not mine:
                crossed.append(i)
            if first is not mine:
                small, large = sorted((first, mine), key=lambda g: len(g.rows))
                large.term = first.term or mine.term
                large.rows += small.rows
                for r in small.rows:
                    group[r] = large
            for r in (i, j):
                if best[r][0] < sure:
                    best[r] = (sure, rule)
    least = {id(g): min(g.rows) for g in set(group)}
    return [least[id(g)] for g in group], best, crossed


def greedy_merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The definition of the clusters: all observations in id order, one after the other."""
    pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
    owner: dict[str, int] = {}
    links = [[(j, k["rule"], k["confidence"]) for k in keys if (j := owner.setdefault(k["key"], i)) != i] for i, keys in enumerate(pdf["keys"])]
    some = [[x if isinstance(x, str) and x else None for x in pdf[c]] for c in ("source", "code", "fixed_term")]
    roots, best, _ = greedy(*some, links)
    ids = pdf["id"].tolist()
    cluster = ["crs_" + hashlib.sha256(ids[r].encode()).hexdigest()[:8] for r in roots]
    return pd.DataFrame({"id": ids, "cluster": cluster, "root": [ids[r] for r in roots], "rule": [rule or "singleton" for _, rule in best], "confidence": [sure or 1.0 for sure, _ in best]})


_SOLVED = "id string, component string, root string, rule string, confidence double, crossed boolean"


def _links(rows: pa.Table) -> list[list[tuple[int, str, float]]]:
    """(owner's place, rule, confidence) of each row's links, taken column by column."""
    many = rows["links"].combine_chunks()
    flat = many.flatten()
    owner = pc.index_in(flat.field("owner"), value_set=rows["id"].combine_chunks(), skip_nulls=True)
    if owner.null_count != flat.field("owner").null_count:
        raise ValueError("an owner lies outside its component")
    every = list(zip(owner.to_pylist(), flat.field("rule").to_pylist(), flat.field("confidence").to_pylist(), strict=True))
    out, at = [], 0
    for n in pc.list_value_length(many).to_pylist():
        out.append([x for x in every[at : at + n] if x[0] is not None])
        at += n
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clusters of rows (id, source, code, fixed_term, links, component) sorted by component and id, many components at a time."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        ids, component = rows["id"].to_pylist(), rows["component"].to_pylist()
        links = _links(rows)
        roots, best, crossed = greedy(rows["source"].to_pylist(), rows["code"].to_pylist(), rows["fixed_term"].to_pylist(), links)
        torn = {component[i] for i in crossed}
        made = [ids, component, [ids[r] for r in roots], [rule or "singleton" for _, rule in best], [sure or 1.0 for sure, _ in best], [c in torn for c in component]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["id", "component", "root", "rule", "confidence", "crossed"])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= 20_000:
            whole = pa.Table.from_batches(held).combine_chunks()
            last = pc.index(whole["component"], whole["component"][-1]).as_py()
            if last:
                yield solve(whole.slice(0, last))
                held, n = whole.slice(last).to_batches(), len(whole) - last
    if n:
        yield solve(pa.Table.from_batches(held).combine_chunks())


def cluster_greedy(obs: DataFrame) -> DataFrame:
    """(id, cluster, root, rule, confidence) of observations with unique ids.

    A key's owner is its smallest id, so a join finds every row's links at once.  Rows
    alike in source, code, term and links, and no key's owner, are of one kind: after the
    first of a kind the others change nothing and end where it ends, since a group's term
    changes once at most, from none to one.  So only the first row of each kind goes
    through the order-dependent merging, inside its component of links, many components
    to a task; the rows of a kind are joined back, spread where they are many.

    A group's term can change again only where a key of the strongest rule joins groups of
    two different terms.  Components where the merging meets that are merged once more,
    row by row.  A task holds the kinds of a component, of such a one its rows.

    Keys are long and begin alike, which sorting them pays for; they meet as their MD5.
    """
    short = lambda k: F.struct(F.unhex(F.md5(k["key"].cast("binary"))).alias("key"), k["rule"].alias("rule"), k["confidence"].alias("confidence"))
    keyed = cut(blocking_keys(obs).select(F.col("id").cast("string").alias("id"), F.col("source").cast("string").alias("source"), F.col("code").cast("string").alias("code"), "fixed_term", F.transform("keys", short).alias("keys")), "keyed")
    shown = keyed.select("id", F.posexplode("keys").alias("pos", "k")).select("id", "pos", "k.key", "k.rule", "k.confidence")
    owners = cut(shown.groupBy("key").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1"), "owners")
    met = spread_join(shown, owners.drop("n"), "key", hot_keys(owners, "key"), ["id"])
    link = F.struct("pos", F.when(F.col("owner") != F.col("id"), F.col("owner")).alias("owner"), "rule", "confidence")
    rows = keyed.drop("keys").join(met.groupBy("id").agg(F.sort_array(F.collect_list(link)).alias("links")), "id")
    own = F.exists("links", lambda x: x["owner"].isNull())
    rows = cut(rows.withColumn("kind", F.md5(F.to_json(F.struct("source", "code", "fixed_term", "links", F.when(own, F.col("id")).alias("own"))).cast("binary"))), "linked")
    whole = F.struct("id", "source", "code", "fixed_term", "links")
    kinds = cut(rows.groupBy("kind").agg(F.min(whole).alias("x"), F.count(F.lit(1)).alias("n")).select("kind", "n", "x.*"), "kinds")
    pairs = kinds.select("id", F.explode("links.owner").alias("owner")).where("owner is not null")
    comp = components(pairs.select(F.col("owner").alias("a"), F.col("id").alias("b"))).withColumnRenamed("node", "id")

    columns = ["id", "source", "code", "fixed_term", "links", "component"]
    in_order = lambda df: df.select(*columns).repartition("component").sortWithinPartitions("component", "id")
    solved = cut(in_order(kinds.join(comp, "id")).mapInArrow(_solve, _SOLVED), "solved")
    of_kind = kinds.select("id", "kind", "n").join(solved, "id").drop("id")
    out = spread_join(rows.select("id", "kind"), of_kind.drop("n"), "kind", hot_keys(kinds, "kind"), ["id"])
    torn = cut(solved.where("crossed").select("component").distinct(), "torn")
    if not torn.isEmpty():
        again = out.join(torn, "component", "left_semi").select("id", "component").join(rows, "id")
        out = out.join(torn, "component", "left_anti").select("id", "root", "rule", "confidence").unionByName(in_order(again).mapInArrow(_solve, _SOLVED).select("id", "root", "rule", "confidence"))
    alone = keyed.join(rows.select("id"), "id", "left_anti").select("id", F.col("id").alias("root"), F.lit("singleton").alias("rule"), F.lit(1.0).alias("confidence"))
    out = out.select("id", "root", "rule", "confidence").unionByName(alone)
    return out.select("id", F.concat(F.lit("crs_"), hash8(F.col("root"))).alias("cluster"), "root", "rule", "confidence")


def relaxed_components(edges: DataFrame) -> DataFrame:
    """(node, component) without vetoes: what links, directly or not, gets its smallest label."""
    return components(edges)


def registry_index(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry by address and by name, one row a key: the first with coordinates, else the first.

    A name counts with and without its county.
    """
    r = registry.select("venue_id", F.col("city").alias("r_city"), F.col("address_key").alias("r_address"), F.col("name_key").alias("r_name"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    order = F.struct(F.when(_located(F.col("r_lat")), 0).otherwise(1), F.col("venue_id"))
    one = lambda rows, key: rows.where(F.coalesce(F.col(key) != "", F.lit(False))).groupBy(F.col(key).alias("r_key")).agg(F.min_by(F.struct(*r.columns), order).alias("r")).select("r_key", "r.*")
    names = r.withColumn("as", F.explode(F.array_distinct(F.array("r_name", without_county(F.col("r_name"))))))
    return one(r, "r_address"), one(names, "as")


def _located(lat: Column) -> Column:
    return F.coalesce(lat != 0, F.lit(False))


def resolve_venues(courses: DataFrame, registry: DataFrame, geocodes: DataFrame) -> DataFrame:
    """Each course's venue: (cluster, venue_id, method, confidence, lat, lng).

    ``courses`` has cluster, city, address_key, venue_key, provider_key; ``registry``
    venue_id, city, address_key, name_key, lat, lng; ``geocodes`` address_key, lat, lng.
    A derived name's id comes from ``venue_name``, if the courses have that, as written.
    Candidates are the registry row at the address, then the one of the venue's name,
    then the provider's; a name is tried as it stands and then without its county, and
    counts only within one county where both are known.  The first with coordinates
    wins, then the address, then (unless the address is geocoded) the first.  A registry
    row without coordinates takes those of its own address, never the course's.
    Otherwise a venue is derived from address or name; what has neither stays open.
    """
    by_address, by_name = registry_index(registry)
    geo = geocodes.select(F.col("address_key").alias("g_key"), F.col("lat").alias("g_lat"), F.col("lng").alias("g_lng")).dropDuplicates(["g_key"])
    c = cut(courses.join(geo, F.col("address_key") == F.col("g_key"), "left").drop("g_key"), "courses")
    county = county_of(F.col("city").cast("string"))
    other = county_of(F.col("r_city").cast("string"))
    same = county.isNull() | other.isNull() | (county == other)

    def hits(rows: DataFrame, key: Column, index: DataFrame, prio: int, method: str) -> DataFrame:
        return rows.where(key != "").join(index, key == F.col("r_key")).select("cluster", F.lit(prio).alias("prio"), F.lit(method).alias("hit"), "venue_id", "r_address", "r_lat", "r_lng", F.col("g_lat").isNotNull().alias("geocoded"), same.alias("same"))

    found = hits(c, F.col("address_key"), by_address, 0, "registry-address").withColumn("same", F.lit(True))
    for n, col in ((1, "venue_key"), (2, "provider_key")):
        # the whole name before the one without its county
        both = hits(c, F.col(col), by_name, 10 * n, "registry-name").unionByName(hits(c, without_county(F.col(col)), by_name, 10 * n + 1, "registry-name"))
        first = both.groupBy("cluster").agg(F.min_by(F.struct(*both.columns), "prio").alias("x")).select("x.*")
        found = found.unionByName(first)
    rank = F.when(_located(F.col("r_lat")), 0).when(F.col("prio") == 0, 1).when(F.col("geocoded"), 9).otherwise(2)
    best = found.where("same").withColumn("rank", rank).where("rank < 9")
    best = best.groupBy("cluster").agg(F.min_by(F.struct("hit", "venue_id", "r_address", "r_lat", "r_lng"), F.struct("rank", "prio")).alias("x")).select("cluster", "x.*")
    own = geo.select(F.col("g_key").alias("r_address"), F.col("g_lat").alias("o_lat"), F.col("g_lng").alias("o_lng"))
    m = c.join(best.join(own, "r_address", "left"), "cluster", "left")
    some = lambda n: F.coalesce(F.col(n) != "", F.lit(False))
    reg, addr, name = F.col("venue_id").isNotNull(), some("address_key"), some("venue_key")
    made = lambda s: F.concat(F.lit("ven_"), hash8(s))
    listed = _located(F.col("r_lat"))
    lat = F.when(listed, F.col("r_lat")).otherwise(F.col("o_lat"))
    return m.select(
        "cluster",
        F.when(reg, F.col("venue_id")).when(addr, made(F.col("address_key"))).when(name, made(F.concat(F.lit("name:"), "venue_name" if "venue_name" in courses.columns else "venue_key"))).alias("venue_id"),
        F.when(reg, F.col("hit")).when(addr & F.col("g_lat").isNotNull(), "geocoded-address").when(addr, "derived-address").when(name, "derived-name").otherwise("none").alias("method"),
        F.when(reg, F.when(lat.isNotNull(), 0.95).otherwise(0.8)).when(addr, F.when(F.col("g_lat").isNotNull(), 0.95).otherwise(0.6)).when(name, 0.4).otherwise(0.0).alias("confidence"),
        F.when(reg, lat).when(addr, F.col("g_lat")).alias("lat"),
        F.when(reg, F.when(listed, F.col("r_lng")).otherwise(F.col("o_lng"))).when(addr, F.col("g_lng")).alias("lng"),
    )


def venue_rows(relations: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row a venue: attributes of the first cluster (by id) that has them, and its course count."""
    m = relations.where("venue_id is not null").join(attributes, "cluster")
    w = F.struct("cluster")
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c) != ""), w))
    return m.groupBy("venue_id").agg(*[first(c).alias(c) for c in attributes.columns if c != "cluster"], F.count(F.lit(1)).alias("course_count"))
