"""Change tracking: snapshot merges, content hashes, health checks, fetch intervals."""

from __future__ import annotations

import re
from json import dumps

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import let
from .joins import nearest_within

HOUR, DAY = 3_600_000, 86_400_000


def content_hash(*cols: Column) -> Column:
    """SHA-256 of the fields in a fixed order; a missing field differs from an empty one."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\0")) for c in cols]), 256)


#: Patterns of JSON as Spark writes it, without blanks.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_SCALAR = rf'(?:{_STRING}|[^\[\]{{}}",]++)'


def _plain(drop: str, depth: int) -> str:
    """Pattern of texts at most ``depth`` levels deep, without surrogates and with scalars only under dropped keys."""
    token = _STRING.replace(r"[^", r"[^\x{10000}-\x{10FFFF}")
    if drop:
        token = rf"(?!{drop}:[\[{{]){token}"
    token = rf'{token}|[^\[\]{{}}"]++'
    p = f"(?:{token})*+"
    for _ in range(depth):
        p = rf"(?:{token}|[\[{{]{p}[\]}}])*+"
    return f"^{p}$"


def _pruned(text: Column, drop: str) -> Column:
    """``text`` without null fields and without dropped keys, whose values are scalars.

    Every string is matched as a whole and put back, so no match begins inside of one.
    """
    gone = rf"(?:{_STRING}:null(?=[,}}])" + (rf"|{drop}:{_SCALAR})" if drop else ")")
    return F.regexp_replace(text, rf"(?<=\{{)(?:{gone}(?:,|(?=\}})))++|,{gone}|({_STRING})", "$1")


def nested_hash(json: Column, volatile: tuple[str, ...] = (), depth: int = 6) -> Column:
    """SHA-256 of a nested JSON payload that does not depend on how it is written.

    Keys may come in any order at every level and null fields count as absent;
    ``volatile`` keys are left out wherever they are; array order counts.  Text that is
    no JSON is hashed as it is, null stays null.  Levels below ``depth`` are hashed as
    they are written.

    Parsed payloads are written with sorted keys, so most are settled by leaving fields
    out of that text.  Walked level by level, to the same text, are only those that are
    deeper than ``depth``, have a volatile key with an array or object, or characters that
    sort in another order as UTF-8 than as UTF-16.
    """
    drop = F.array(*[F.lit(k) for k in volatile]) if volatile else F.array().cast("array<string>")
    quoted = lambda k: F.substring(F.to_json(F.struct(k.alias("k"))), F.lit(6), F.length(F.to_json(F.struct(k.alias("k")))) - 6)  # noqa: E731  {"k":"name"}

    def canon(v: Column, left: int) -> Column:
        if left == 0:
            return F.to_json(v)

        def of_object(m: Column) -> Column:
            kept = F.filter(F.array_sort(F.map_keys(m)), lambda k: ~F.coalesce(F.is_variant_null(F.element_at(m, k)), F.lit(True)) & ~F.array_contains(drop, k))
            return F.transform(kept, lambda k: F.struct(F.concat(quoted(k), F.lit(":")).alias("name"), F.element_at(m, k).alias("value")))

        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit("").alias("name"), x.alias("value")))
        children = F.coalesce(let(F.try_variant_get(v, "$", "map<string,variant>"), of_object), items)
        texts = F.transform(children, lambda c: F.concat(c["name"], F.coalesce(let(c["value"], lambda x: canon(x, left - 1)), F.lit("null"))))
        nested = lambda t: F.concat(F.substring(t, 1, 1), F.array_join(texts, ","), F.substring(t, -1, 1))
        return let(F.to_json(v), lambda t: F.when(t.rlike(r"^[\[{]"), nested(t)).otherwise(t))

    names = "|".join(re.escape(dumps(k, ensure_ascii=False)) for k in volatile)
    names = f"(?:{names})" if names else ""
    text = F.to_json(F.try_parse_json(json))
    walked = let(F.try_parse_json(json), lambda v: canon(v, depth))
    return F.sha2(F.when(text.isNull(), json).when(text.rlike(_plain(names, depth)), _pruned(text, names)).otherwise(walked), 256)


def struct_hash(payload: Column) -> Column:
    """SHA-256 of a struct's JSON; null fields are left out of it."""
    return F.sha2(F.to_json(payload), 256)


def snapshot_merge(new: DataFrame, old: DataFrame, key: str, today: Column) -> DataFrame:
    """Merge a snapshot into the history: one full outer join.

    ``new`` has key, payload and content_hash; ``old`` also has first_observed,
    last_verified, last_changed and disappeared.  What is no longer listed keeps
    its row and gets a date of disappearance; what reappears loses that date.  Keys are
    unique on both sides; rows with a null key are no listings and take no part.
    """
    n, o = new.where(F.col(key).isNotNull()).alias("n"), old.where(F.col(key).isNotNull()).alias("o")
    m = n.join(o, F.col(f"n.{key}") == F.col(f"o.{key}"), "full_outer")
    is_new, gone = F.col(f"o.{key}").isNull(), F.col(f"n.{key}").isNull()
    same = F.col("n.content_hash") == F.col("o.content_hash")
    return m.select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key),
        F.when(gone, F.col("o.content_hash")).otherwise(F.col("n.content_hash")).alias("content_hash"),
        F.when(gone, F.col("o.payload")).otherwise(F.col("n.payload")).alias("payload"),
        F.when(is_new, today).otherwise(F.col("o.first_observed")).alias("first_observed"),
        F.when(gone, F.col("o.last_verified")).otherwise(today).alias("last_verified"),
        F.when(gone | same, F.col("o.last_changed")).otherwise(today).alias("last_changed"),
        F.when(gone, F.coalesce("o.disappeared", today)).alias("disappeared"),
        F.when(is_new, "added").when(gone, "disappeared").when(same, "verified").otherwise("changed").alias("change"),
    )


def merge_stats(merged: DataFrame) -> DataFrame:
    return merged.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def next_interval(interval: Column, changed: Column, unchanged_runs: Column, failed: Column, least: Column, most: Column, boosted: Column) -> Column:
    """Half after a change, half as long again without one; the ceiling is 30 days after ten runs."""
    low = F.when(boosted, least / 2).otherwise(least)
    ceiling = F.when(unchanged_runs >= 10, F.greatest(most, F.lit(30 * DAY))).otherwise(most)
    return F.when(failed, interval).when(changed, F.greatest(low, F.least(interval / 2, most))).otherwise(F.least(ceiling, interval * 1.5)).cast("long")


def next_state(state: DataFrame, run: DataFrame, least: int = 6 * HOUR, most: int = 7 * DAY) -> DataFrame:
    """The schedule after a run: state (source, content_hash, interval_ms, unchanged, failures) with
    run (source, at_ms, new_hash, failed)."""
    s = state.join(run, "source")
    changed = ~F.col("failed") & ~F.col("content_hash").eqNullSafe(F.col("new_hash"))
    unchanged = F.when(F.col("failed"), F.col("unchanged")).when(changed, 0).otherwise(F.col("unchanged") + 1)
    s = s.withColumn("runs", unchanged.cast("long"))
    step = next_interval(F.col("interval_ms"), changed, F.col("runs"), F.col("failed"), F.lit(least), F.lit(most), F.lit(False))
    return s.select(
        "source",
        F.when(F.col("failed"), F.col("content_hash")).otherwise(F.col("new_hash")).alias("content_hash"),
        step.alias("interval_ms"),
        F.col("runs").alias("unchanged"),
        F.when(F.col("failed"), F.col("failures") + 1).otherwise(0).cast("long").alias("failures"),
        (F.col("at_ms") + step).alias("next_due_ms"),
    )


def is_due(next_due: Column, now: Column) -> Column:
    return next_due.isNull() | (next_due <= now)


def health(history: DataFrame, in_window: Column, key: str = "source", day: str = "day", n: str = "n", year: int = 365, within: int = 10, fall: float = 0.5) -> DataFrame:
    """ok, warn or fail for every day of every source, against the day before and the year before."""
    last = F.lag(n).over(W.partitionBy(key).orderBy(day))
    now = history.withColumn("previous", last).withColumn("in_window", in_window)
    before = nearest_within(history, history, [key], day, F.date_sub(F.col(day), year), day, within, []).select(key, day, "matched_day")
    then = history.select(F.col(key).alias("__k"), F.col(day).alias("matched_day"), F.col(n).alias("year_ago"))
    before = before.join(then.withColumnRenamed("__k", key), [key, "matched_day"]).select(key, day, "year_ago")
    m = now.join(before, [key, day], "left")
    fell = lambda old: (old > 0) & ((old - F.col(n)) / old > fall)
    verdict = F.when(F.col("previous").isNull(), "ok").when((F.col(n) == 0) & (F.col("previous") > 0), "fail")
    verdict = verdict.when(F.coalesce(fell(F.col("year_ago")), F.lit(False)), "fail")
    verdict = verdict.when(fell(F.col("previous")), F.when(F.col("in_window"), "warn").otherwise("fail")).otherwise("ok")
    return m.withColumn("verdict", verdict)


def last_good(attempts: DataFrame, key: str, at: str, ok: Column, value: str) -> DataFrame:
    """The last accepted value of each key, whatever failed since."""
    return attempts.where(ok).groupBy(key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def cache_merge(cache: DataFrame, results: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Upsert results into a cache; results win."""
    c, r = cache.alias("c"), results.alias("r")
    m = c.join(r, F.col(f"c.{key}") == F.col(f"r.{key}"), "full_outer")
    hit = F.col(f"r.{key}").isNotNull()
    return m.select(F.coalesce(f"r.{key}", f"c.{key}").alias(key), *[F.when(hit, F.col(f"r.{f}")).otherwise(F.col(f"c.{f}")).alias(f) for f in fields])
