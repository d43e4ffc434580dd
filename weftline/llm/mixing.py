"""Mixing sources to target weights: hierarchical budgets, seeded epochs.

Documents hang under a tree of levels (domain, language, source).  A budget of
tokens enters at the root and moves down: children share their parent's budget
by weight.  ``targets`` gives the shares of a level's values in thousandths of their
parent's budget; values that it does not list share what is left, by default weights
(the sum of a power of their leaves' supplies).  A child whose whole subtree cannot supply its share (supply times
``max_epochs``) takes what it can, and the shortage is shared out among its
siblings, again by weight; only what all siblings together cannot take stays
with the parent, whose own siblings then take it.  Since a child's capacity
counts its whole subtree, capped sharing from the root down does just that.

A leaf reads its documents in epochs, each in its own seeded order; it takes
whole epochs and then the longest prefix of the next one that its budget holds.

All token sums are whole numbers, so the result is the same on every engine.  Shares
are rounded down, which leaves at most one token a child unspent.

A hot leaf is never sorted in one task: an epoch's order is by a hash, documents
are counted by hash slices (as many slices as the leaf needs to hold about
``SLICE`` documents each), sums run over slices, and only the one slice in which
the budget ends is ordered by row.  There, rows equal in id and length count as one,
so rows that all have one id (or none) are no hot group either.

Edge cases: null level values are a value of their own; a null or empty text has
no tokens and is kept whenever its place in the order lies in the prefix; a
leaf without tokens gets its documents once.  Rows with equal ids come together
in the order, by length.  Texts are counted whole.  Of the input only levels, id and
tokens are read, so other columns cannot clash.  A target for a value that does not occur
goes to nobody.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import cut, table

LEVELS = ("domain", "lang", "source")
SEED = 17
SLICE = 4096
MAX_EPOCHS = 4
#: What the query asks for, in thousandths: half of all tokens from the web, and so on.
TARGETS = {"domain": {"web": 500, "books": 300}, "lang": {"en": 400}}


def n_words(text: Column) -> Column:
    """Number of words (runs without ASCII white space)."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x09-\x0D ]+|[\x09-\x0D ]+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"[\x09-\x0D ]+"))).cast("long")


def shares(children: DataFrame, parent_cols: list[str], name: str) -> DataFrame:
    """Budget of each child of (parent.., name, capacity, weight, parent_budget).

    Children are filled in order of capacity over weight.  The first whose fair
    share of what is left is below its capacity, and all after it, take that
    share; whoever comes before takes its capacity.
    """
    order = W.partitionBy(*parent_cols).orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(name).asc_nulls_first())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    c = children.withColumn("left", F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    c = c.withColumn("weights", F.sum("weight").over(rest))
    fits = F.col("capacity").cast("decimal(38,0)") * F.col("weights") <= F.col("left").cast("decimal(38,0)") * F.col("weight")
    c = c.withColumn("full", F.min(F.when(fits, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)) == 1)
    first = F.row_number().over(W.partitionBy(*parent_cols, "full").orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(name).asc_nulls_first())) == 1
    c = c.withColumn("opens", ~F.col("full") & first)
    whole = W.partitionBy(*parent_cols)
    c = c.withColumn("open_left", F.max(F.when(F.col("opens"), F.col("left"))).over(whole)).withColumn("open_weights", F.max(F.when(F.col("opens"), F.col("weights"))).over(whole))
    share = F.floor(F.col("open_left").cast("decimal(38,0)") * F.col("weight") / F.col("open_weights")).cast("long")
    return c.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(share))


def targeted(children: DataFrame, parent_cols: list[str], name: str, shares_of: Mapping[str, int]) -> DataFrame:
    """``children`` with weights such that listed values have their thousandths of the siblings' sum."""
    if not shares_of:
        return children
    listed = sum(shares_of.values())
    if listed > 1000 or min(shares_of.values()) < 1:
        raise ValueError(f"target shares of {name} must be positive and add up to 1000 at most")
    share = F.lit(None).cast("long")
    for value, parts in shares_of.items():
        share = F.when(F.col(name) == value, F.lit(parts).cast("long")).otherwise(share)
    siblings = W.partitionBy(*parent_cols)
    c = children.withColumn("share", share)
    c = c.withColumn("others", F.greatest(F.coalesce(F.sum(F.when(F.col("share").isNull(), F.col("weight"))).over(siblings), F.lit(0)), F.lit(1)))
    return c.withColumn("weight", F.greatest(F.coalesce(F.col("share") * F.col("others"), F.col("weight") * (1000 - listed)), F.lit(1))).drop("share", "others")


def leaf_budgets(leaves: DataFrame, levels: tuple[str, ...], budget: Column, max_epochs: int, targets: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """(levels.., supply, budget) from (levels.., supply, weight); without targets a node's weight is its leaves' sum."""
    nodes = None
    for depth in range(1, len(levels) + 1):
        keys, name = list(levels[: depth - 1]), levels[depth - 1]
        mine = leaves.groupBy(*levels[:depth]).agg((F.sum("supply") * max_epochs).alias("capacity"), F.sum("weight").alias("weight"))
        mine = targeted(mine, keys or [F.lit(0)], name, (targets or {}).get(name, {}))
        if nodes is None:
            mine = mine.withColumn("parent_budget", budget)
        else:
            p = nodes.select(*[F.col(k).alias(f"p_{k}") for k in keys], F.col("budget").alias("parent_budget"))
            on = F.lit(True)
            for k in keys:
                on = on & F.col(k).eqNullSafe(F.col(f"p_{k}"))
            mine = mine.join(p, on).drop(*[f"p_{k}" for k in keys])
        nodes = shares(mine, keys or [F.lit(0)], name).select(*levels[:depth], "capacity", "budget")
    return nodes.withColumn("supply", (F.col("capacity") / max_epochs).cast("long")).select(*levels, "supply", "budget")


def mix_sources(
    docs: DataFrame,
    levels: tuple[str, ...] = LEVELS,
    id_col: str = "doc_id",
    tokens_col: str = "n_tokens",
    fraction: tuple[int, int] = (1, 2),
    power: float = 0.5,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    targets: Mapping[str, Mapping[str, int]] | None = None,
) -> DataFrame:
    """(levels.., id, tokens, epoch): one row for each time a document is taken.

    The budget is ``fraction`` of all tokens.  ``targets`` are shares by level and value;
    elsewhere a leaf's weight is its supply to the given power, in whole numbers: 1 keeps
    proportions, 0 evens them out.
    """
    num, den = fraction
    d = cut(docs.select(*levels, F.col(id_col).alias("__id"), F.col(tokens_col).cast("long").alias("__t")), "lengths")
    leaves = cut(d.groupBy(*levels).agg(F.sum("__t").alias("supply"), F.count(F.lit(1)).alias("n")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("t")).first()["t"]
    budget = F.lit(total * num // den).cast("long")
    weighed = leaves.withColumn("weight", F.greatest(F.round(F.pow("supply", F.lit(power))).cast("long"), F.lit(1)))
    plan = leaf_budgets(weighed, levels, budget, max_epochs, targets)
    key = [f"l_{k}" for k in levels]
    plan = plan.join(leaves.select(*[F.col(k).alias(f"l_{k}") for k in levels], "n"), _same(levels, "l_"))
    whole = F.when(F.col("supply") > 0, F.least(F.floor(F.col("budget") / F.col("supply")), F.lit(max_epochs))).otherwise(1)
    plan = plan.withColumn("epochs", whole.cast("int")).withColumn("rest", F.when(F.col("supply") > 0, F.col("budget") - F.col("supply") * F.col("epochs")).otherwise(0))
    plan = cut(plan.withColumn("slices", F.greatest(F.ceil(F.col("n") / SLICE), F.lit(1)).cast("long")).select(*key, "epochs", "rest", "slices"), "plan")

    joined = d.join(plan, _same(levels, "l_")).drop(*key)
    full = joined.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    # the order of the last epoch: by hash, cut in slices
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("__id").cast("string"))), 1, 13), 16, 10).cast("long")
    part = joined.where("rest > 0").withColumn("order", order).withColumn("slice", F.floor(F.col("order") * F.col("slices") / F.lit(float(1 << 52))).cast("long"))
    part = part.withColumnRenamed("epochs", "epoch")
    sums = part.groupBy(*levels, "slice").agg(F.sum("__t").alias("t"), F.first("rest").alias("rest"))
    run = W.partitionBy(*levels).orderBy("slice").rowsBetween(W.unboundedPreceding, 0)
    passed = sums.withColumn("upto", F.sum("t").over(run)).where("upto > rest")
    ends = passed.groupBy(*[F.col(k).alias(f"s_{k}") for k in levels]).agg(F.min(F.struct(F.col("slice"), (F.col("upto") - F.col("t")).alias("before"))).alias("end"))
    placed = part.join(cut(ends, "ends"), _same(levels, "s_"), "left").drop(*[f"s_{k}" for k in levels])
    inside = placed.where("end is null or slice < end.slice")
    edge = _prefix(placed.where("slice = end.slice"), levels)
    cols = [*levels, F.col("__id").alias(id_col), F.col("__t").alias(tokens_col), F.col("epoch").cast("int").alias("epoch")]
    return full.select(*cols).unionByName(inside.select(*cols)).unionByName(edge.select(*cols))


def _prefix(edge: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """The rows of each leaf's last slice that its budget still holds, in the slice's order.

    Rows that are equal in leaf, id and length are counted before they are ordered, so very
    many of them are one row of the window; as many as fit are then written out again, in
    chunks that are dealt out over the tasks.
    """
    same = edge.groupBy(*levels, "order", "__id", "__t", "epoch").agg(F.count(F.lit(1)).alias("many"), F.first("end.before").alias("before"), F.first("rest").alias("rest"))
    each = F.coalesce(F.col("__t"), F.lit(0))
    rows = W.partitionBy(*levels).orderBy("order", F.col("__id").asc_nulls_first(), F.col("__t").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    room = F.col("rest") - F.col("before") - (F.sum(each * F.col("many")).over(rows) - each * F.col("many"))
    fit = F.when(F.col("room") < 0, 0).when(each == 0, F.col("many")).otherwise(F.least("many", F.floor(F.col("room") / each)))
    taken = same.withColumn("room", room).withColumn("fit", fit.cast("long")).where("fit > 0").select(*levels, "__id", "__t", "epoch", "fit")
    chunks = taken.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("fit") - 1) / SLICE))))
    dealt = chunks.repartition(*levels, "__id", "__t", "chunk")
    here = F.least(F.lit(SLICE).cast("long"), F.col("fit") - F.col("chunk") * SLICE)
    return dealt.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), here))).drop("__n", "fit", "chunk")


def _same(levels: tuple[str, ...], prefix: str) -> Column:
    on = F.lit(True)
    for k in levels:
        on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return on


def domain_of(source: Column) -> Column:
    """The domain level of the given tables: sources by the last digit of their name."""
    last = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9])$", 1)
    return F.when(last == "", "other").when(last.isin("0", "1", "2", "3"), "web").when(last.isin("4", "5", "6"), "books").otherwise("forums")


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    """The documents (with epochs) that make up half of all tokens at target weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", n_words(F.col("text")).alias("n_tokens"))
    return mix_sources(docs.withColumn("domain", domain_of(F.col("source"))), targets=TARGETS).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _oracle() -> str:
    def level(depth: int) -> str:
        keys = LEVELS[:depth]
        by, up = ", ".join(keys), ", ".join(keys[:-1])
        part = f"PARTITION BY {up}" if up else ""
        both = f"PARTITION BY {up + ', ' if up else ''}is_full"
        order = f"ORDER BY capacity / weight, {keys[-1]} NULLS FIRST"
        parent = "(SELECT CAST(sum(supply) AS BIGINT) // 2 FROM leaves)" if depth == 1 else "p.budget"
        join = "" if depth == 1 else f" JOIN n{depth - 1} p ON " + " AND ".join(f"m.{k} IS NOT DISTINCT FROM p.{k}" for k in keys[:-1])
        asked = TARGETS.get(keys[-1], {})
        weighed = f"w{depth} AS (SELECT * FROM m{depth}),"
        if asked:
            cases = " ".join(f"WHEN {keys[-1]} = '{v}' THEN {n}" for v, n in asked.items())
            weighed = f"""s{depth} AS (SELECT *, CASE {cases} END AS share FROM m{depth}),
w{depth} AS (SELECT {by}, capacity, CAST(greatest(coalesce(share * greatest(coalesce(sum(CASE WHEN share IS NULL THEN weight END) OVER ({part}), 0), 1), weight * {1000 - sum(asked.values())}), 1) AS BIGINT) AS weight FROM s{depth}),"""
        return f"""
m{depth} AS (SELECT {by}, CAST(sum(supply) * {MAX_EPOCHS} AS BIGINT) AS capacity, CAST(sum(weight) AS BIGINT) AS weight FROM leaves GROUP BY {by}),
{weighed}
a{depth} AS (SELECT m.*, {parent} AS parent_budget FROM w{depth} m{join}),
b{depth} AS (SELECT *, parent_budget - coalesce(sum(capacity) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(weight) OVER ({part} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM a{depth}),
c{depth} AS (SELECT *, min(CASE WHEN capacity::HUGEINT * weights <= lft::HUGEINT * weight THEN 1 ELSE 0 END) OVER ({part} {order} ROWS UNBOUNDED PRECEDING) = 1 AS is_full FROM b{depth}),
d{depth} AS (SELECT *, NOT is_full AND row_number() OVER ({both} {order}) = 1 AS opens FROM c{depth}),
n{depth} AS (SELECT {by}, capacity, CAST(CASE WHEN is_full THEN capacity ELSE (max(CASE WHEN opens THEN lft END) OVER ({part}))::HUGEINT * weight // (max(CASE WHEN opens THEN weights END) OVER ({part})) END AS BIGINT) AS budget FROM d{depth})"""

    return f"""
WITH docs AS (SELECT doc_id, lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D ]+')) AS BIGINT) AS n_tokens,
  CASE WHEN regexp_extract(coalesce(source, ''), '([0-9])$', 1) = '' THEN 'other'
    WHEN regexp_extract(source, '([0-9])$', 1) IN ('0', '1', '2', '3') THEN 'web'
    WHEN regexp_extract(source, '([0-9])$', 1) IN ('4', '5', '6') THEN 'books' ELSE 'forums' END AS domain FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS supply, greatest(CAST(round(pow(sum(n_tokens), 0.5)) AS BIGINT), 1) AS weight FROM docs GROUP BY ALL),
{level(1)},
{level(2)},
{level(3)},
plan AS (SELECT n.domain, n.lang, n.source, l.supply, n.budget,
  CAST(CASE WHEN l.supply > 0 THEN least(n.budget // l.supply, {MAX_EPOCHS}) ELSE 1 END AS INTEGER) AS epochs
  FROM n3 n JOIN leaves l ON n.domain IS NOT DISTINCT FROM l.domain AND n.lang IS NOT DISTINCT FROM l.lang AND n.source IS NOT DISTINCT FROM l.source),
j AS (SELECT d.*, p.epochs, CASE WHEN p.supply > 0 THEN p.budget - p.supply * p.epochs ELSE 0 END AS rest
  FROM docs d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
o AS (SELECT *, substr(md5('{SEED}:' || epochs || ':' || doc_id), 1, 13) AS h FROM j WHERE rest > 0),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM o)
SELECT doc_id, domain, lang, source, n_tokens, CAST(e.epoch AS INTEGER) AS epoch FROM j, LATERAL (SELECT unnest(range(j.epochs)) AS epoch) e
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, epochs AS epoch FROM r WHERE upto <= rest
"""


ORACLE = _oracle()
