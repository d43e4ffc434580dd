"""Rule tables as data: patterns filed under literals that every match needs.

A rule's pattern is read once for literals: of each alternative one must be in any text
that the pattern matches.  Literals of up to eight characters are filed as they are, longer
ones under one of their runs of eight; a text fetches, by its own runs of the lengths that
are filed, only the rules it may match, and only those are tried.  A plan does not grow
with the table, which may hold any number of rules: no side of a join that may be large
is broadcast, whatever its files weigh.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

try:
    from re import _parser as _sre
except ImportError:  # before Python 3.11
    import sre_parse as _sre  # type: ignore[no-redef]

RUN = 8
MOST_UNFILED = 64


def _needed(seq) -> list[list[str]]:
    """Each entry is a set of literals of which any match holds at least one."""
    found, run = [], ""
    for op, arg in seq:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        if run:
            found.append([run])
            run = ""
        if name == "SUBPATTERN":
            found += _needed(arg[-1])
        elif name == "BRANCH":
            each = [_needed(x) for x in arg[1]]
            if all(each):
                found.append(sorted({x for e in each for x in max(e, key=lambda o: min(map(len, o)))}))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            found += _needed(arg[2])
    return [*found, [run]] if run else found


def needed_literals(pattern: str) -> list[list[str]]:
    """Sets of lower-cased literals, one of each of which every match holds; none if none are known."""
    try:
        return [[x.lower() for x in option] for option in _needed(_sre.parse(pattern))]
    except (re.error, OverflowError):
        return []


def filed(rules: DataFrame) -> DataFrame:
    """(ord, option, literal, run): every rule under every run of each of its literals; null without any."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at, pattern in zip(pdf["ord"], pdf["pattern"], strict=True):
                options = needed_literals(pattern) if isinstance(pattern, str) else []
                rows += [(at, k, x, x[i : i + RUN]) for k, option in enumerate(options) for x in option for i in range(max(1, len(x) - RUN + 1))]
                if not options:
                    rows.append((at, None, None, None))
            yield pd.DataFrame(rows, columns=["ord", "option", "literal", "run"]).astype({"option": "Int32"})

    return rules.select(F.col("ord").cast("long").alias("ord"), "pattern").mapInPandas(read, "ord long, option int, literal string, run string")


def runs_of(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, run): the distinct runs of each text (id, text) of some lengths, in time proportional to its length."""
    if not lengths:
        return texts.select("id", F.lit(None).cast("string").alias("run")).where("false")
    at = lambda n: F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    found = at(lengths[0])
    for n in lengths[1:]:
        found = F.when(F.col("n") == n, at(n)).otherwise(found)
    return texts.withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths]))).select("id", F.explode(F.array_distinct(found)).alias("run"))


def label_texts(texts: DataFrame, rules: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, ord): all rules (ord, pattern) that texts with unique ids match, whatever their case.

    Null ids and texts match nothing, null patterns too.  At most ``MOST_UNFILED`` rules
    may be without any literal: those are tried on every text.
    """
    t = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    rules = cut(rules.where("pattern is not null").select(F.col("ord").cast("long").alias("ord"), "pattern"), "rules")
    index = cut(filed(rules), "index")
    runs = index.where("run is not null").select("run").distinct()
    lengths = sorted(r[0] for r in runs.select(F.char_length("run")).distinct().collect())  # RUN numbers at most
    own = cut(runs_of(t.withColumn("text", F.lower("text")), lengths).join(runs.hint("shuffle_merge"), "run"), "runs")
    # each literal under its rarest run, each rule under the rarest of its literal sets
    counts = own.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = index.where("run is not null").join(counts.hint("shuffle_merge"), "run", "left").groupBy("ord", "option", "literal").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("best"))
    options = rarest.groupBy("ord", "option").agg(F.sum("best.n").alias("n"), F.collect_set(F.struct(F.col("best.run").alias("run"), "literal")).alias("under"))
    chosen = options.groupBy("ord").agg(F.min_by("under", F.struct("n", "option")).alias("under")).select("ord", F.explode("under").alias("u")).select("ord", "u.run", "u.literal")
    # the pattern comes along, so that what is fetched is joined with the rules no more
    chosen = cut(chosen.join(rules.hint("shuffle_merge"), "ord"), "chosen")
    fetched = own.join(chosen.hint("shuffle_merge"), "run").join(t.hint("shuffle_merge"), "id").where(F.contains(F.lower("text"), F.col("literal")))
    tried = fetched.where(F.expr("text rlike concat('(?iu)', pattern)")).select("id", "ord").distinct()
    rest = [r["pattern_ord"] for r in index.where("run is null").select(F.col("ord").alias("pattern_ord")).limit(MOST_UNFILED + 1).collect()]
    if len(rest) > MOST_UNFILED:
        raise ValueError(f"more than {MOST_UNFILED} rules have no literal that every match needs, such as rule {min(rest)}")
    if rest:
        patterns = rules.where(F.col("ord").isin(rest)).collect()
        hits = F.array_compact(F.array(*[F.when(F.col("text").rlike("(?iu)" + r["pattern"]), F.lit(r["ord"])) for r in patterns]))
        tried = tried.unionByName(t.select("id", F.explode(hits).alias("ord")))
    return tried
