"""Projecting nested payloads field by field.

Every member's payload is cut into its leaves, rows of (path, value); the best value of
each path wins on its own, and the winners are put together again.  Which value is best
is the caller's order: by falling confidence, then source priority, then record.
A key of few members is settled in its own row, the others by grouping their leaves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .skew import hot_keys

MANY = 1024  # members of a key that one row may hold


def leaves(schema: T.StructType, base: str = "") -> list[tuple[str, T.DataType]]:
    """(path, type) of every leaf; arrays and maps are leaves."""
    out = []
    for f in schema:
        path = f"{base}.{f.name}" if base else f.name
        out += leaves(f.dataType, path) if isinstance(f.dataType, T.StructType) else [(path, f.dataType)]
    return out


def _text(c: Column, t: T.DataType) -> Column:
    """A leaf as text: strings as they are, others as JSON."""
    return c if isinstance(t, T.StringType) else F.to_json(F.struct(c.alias("v")))


def _value(text: Column, t: T.DataType) -> Column:
    return text if isinstance(t, T.StringType) else F.from_json(text, T.StructType([T.StructField("v", t)]))["v"]


def _there(c: Column, t: T.DataType) -> Column:
    return c.isNotNull() & (F.trim(c) != "") if isinstance(t, T.StringType) else c.isNotNull()


def path_rows(members: DataFrame, payload: str, keep: list[Column | str]) -> DataFrame:
    """(keep.., path, value): one row for each leaf that is there, its value as text.

    Blank text counts as missing.
    """
    kind = members.schema[payload].dataType
    made = []
    for path, t in leaves(kind):
        c = F.col(f"{payload}.{path}")
        made.append(F.when(_there(c, t), F.struct(F.lit(path).alias("path"), _text(c, t).alias("value"))))
    return members.select(*keep, F.explode(F.array_compact(F.array(*made))).alias("leaf")).select("*", "leaf.path", "leaf.value").drop("leaf")


def rebuilt(kind: T.StructType, value: Callable[[str], Column], base: str = "") -> Column:
    """A struct of ``kind`` from the text of each path; a struct without any leaf is null."""
    parts, there = [], F.lit(False)
    for f in kind:
        path = f"{base}.{f.name}" if base else f.name
        c = rebuilt(f.dataType, value, path) if isinstance(f.dataType, T.StructType) else _value(value(path), f.dataType)
        parts.append(c.alias(f.name))
    for path, _ in leaves(kind, base):
        there = there | value(path).isNotNull()
    return F.when(there, F.struct(*parts))


def project_paths(members: DataFrame, key: str, payload: str, source: str, record: str, confidence: str, priority: str, spans: list[tuple[str, str]] = (), many: int = MANY) -> DataFrame:
    """(key, payload, sources, lost): one payload a key, of the best value of every path.

    ``spans`` are pairs of paths, a start and an end: the best start stands, and of the
    ends the best one that does not lie before it, so no span is ever inverted; values are
    compared as text, as ISO dates can be.  ``sources`` maps a path to the source of its
    value, ``lost`` counts values of a path that differ from the winner.  Keys without any
    value are left out, and so are members without a key.

    Members of a key meet in one row, where every path is settled in place: one shuffle
    of members, none of leaves.  Keys of more than ``many`` members are counted out first
    and grouped by key and path, so no task gathers an entity.
    """
    members = members.where(F.col(key).isNotNull())
    order = [(-F.col(confidence)).alias("c"), F.col(priority).alias("p"), F.col(source).alias("s"), F.col(record).alias("r")]
    hot = hot_keys(members.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, per_salt=many)
    if hot is None:
        return _in_rows(members, key, payload, order, spans)
    hot = F.broadcast(hot.select(key))
    grouped = _in_groups(members.join(hot, key, "left_semi"), key, payload, source, order, spans)
    return _in_rows(members.join(hot, key, "left_anti"), key, payload, order, spans).unionByName(grouped)


def _in_rows(members: DataFrame, key: str, payload: str, order: list[Column], spans: list[tuple[str, str]]) -> DataFrame:
    kind = members.schema[payload].dataType
    at = {path: f"v{n}" for n, (path, _) in enumerate(leaves(kind))}
    values = [F.when(_there(F.col(f"{payload}.{path}"), t), _text(F.col(f"{payload}.{path}"), t)).alias(at[path]) for path, t in leaves(kind)]
    names = ["c", "p", "s", "r", *at.values()]
    rows = members.select(F.col(key).alias("k"), *order, *values).repartition("k")
    # members without a value are left out here: a filter would be pushed down and work out the payload once more
    some = F.when(F.coalesce(*at.values()).isNotNull(), F.struct(*names))
    one = rows.groupBy("k").agg(F.sort_array(F.collect_list(some)).alias("rows")).where(F.size("rows") > 0)
    having = lambda path: F.filter("rows", lambda x: x[at[path]].isNotNull())
    least = {end: (start, f"least{n}") for n, (start, end) in enumerate(spans)}
    one = one.select("k", "rows", *[F.get(having(start), F.lit(0))[at[start]].alias(name) for start, name in least.values()])

    def kept(path: str) -> Column:
        if path not in least:
            return having(path)
        start = F.col(least[path][1])
        return F.filter("rows", lambda x: x[at[path]].isNotNull() & (start.isNull() | (x[at[path]] >= start)))

    one = one.select("k", *[kept(path).alias(v) for path, v in at.items()])
    best = lambda path: F.get(at[path], F.lit(0))
    kinds = lambda path: F.size(F.array_distinct(F.col(at[path])[at[path]])).cast("long")
    entries = lambda one: F.map_from_entries(F.array_compact(F.array(*[one(path) for path in sorted(at)])))  # noqa: E731  sorted as grouped ones are
    return one.select(
        F.col("k").alias(key),
        rebuilt(kind, lambda path: best(path)[at[path]]).alias(payload),
        entries(lambda path: F.when(F.size(at[path]) > 0, F.struct(F.lit(path).alias("path"), best(path)["s"].alias("source")))).alias("sources"),
        entries(lambda path: F.when(kinds(path) > 1, F.struct(F.lit(path).alias("path"), (kinds(path) - 1).alias("n")))).alias("lost"),
    )


def _in_groups(members: DataFrame, key: str, payload: str, source: str, order: list[Column], spans: list[tuple[str, str]]) -> DataFrame:
    kind = members.schema[payload].dataType
    rows = path_rows(members, payload, [key, source, F.struct(*order).alias("o")])
    ends = {end: start for start, end in spans}
    if ends:
        best_start = F.min_by("value", "o").alias("least")
        starts = rows.where(F.col("path").isin(*ends.values())).groupBy(key, F.col("path").alias("start")).agg(best_start)
        of = F.create_map(*[F.lit(x) for pair in ends.items() for x in pair])
        rows = rows.withColumn("start", F.element_at(of, F.col("path"))).join(starts, [key, "start"], "left").where(F.col("least").isNull() | (F.col("value") >= F.col("least"))).drop("start", "least")
    best = rows.groupBy(key, "path").agg(F.min_by("value", "o").alias("value"), F.min_by(source, "o").alias("source"), F.count_distinct("value").alias("kinds"))
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", c))))  # noqa: E731  at most one row a path
    one = best.groupBy(key).agg(entry("value").alias("values"), entry("source").alias("sources"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kinds") > 1, F.struct("path", (F.col("kinds") - 1).alias("n")))))).alias("lost"))
    return one.select(key, rebuilt(kind, lambda path: F.element_at("values", path)).alias(payload), "sources", "lost")
