"""Distributed union-find: connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, drop
from .skew import hot_keys, spread_join


BY_NAME = 2  # rounds in which the smallest node comes first


def components(edges: DataFrame, a: str = "a", b: str = "b", report: list | None = None) -> DataFrame:
    """(node, component) of every node of ``edges``; component is its smallest node.

    In each round every node hangs under the first of itself and its neighbours; edges
    are contracted along those parents.  In two rounds the smallest comes first, which
    settles stars around small nodes at once.  From then on a hash, another one each
    round, decides: whatever the graph looks like, a constant share of the nodes that
    still have edges goes in each round, so the number of rounds grows with the logarithm
    of the table.  Parents are then followed from the last round back to the first, and
    each tree takes its smallest node as its name.  Joins spread nodes with very many
    neighbours, so no step gathers a component in one task.  Null ends and self-loops
    join nothing.  ``report`` is given the number of edges of each round.
    """
    kind = edges.schema[a].dataType
    e = edges.select(F.col(a).alias("a"), F.col(b).cast(kind).alias("b")).where("a <> b")
    e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[tuple[DataFrame, DataFrame | None]] = []
    while n := e.count():
        if report is not None:
            report.append(n)
        ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
        first = lambda c: F.struct((F.xxhash64(F.lit(len(rounds)), c) if len(rounds) >= BY_NAME else F.lit(0)).alias("p"), c.alias("at"))  # noqa: B023, E731
        near = e.select(F.explode(ends).alias("x")).select("x.node", "x.other").groupBy("node").agg(F.min(first(F.col("other"))).alias("best"), F.count(F.lit(1)).alias("n"))
        up = cut(near.select("node", F.least(F.col("best"), first(F.col("node")))["at"].alias("up"), "n"), "parents")
        hot = hot_keys(up, "node") if n > 4096 else None
        for end in ("a", "b"):
            of = up.select(F.col("node").alias(end), F.col("up").alias(f"p{end}"))
            e_hot = hot.withColumnRenamed("node", end) if hot is not None else None
            if end == "a":
                met = spread_join(e, of, "a", e_hot, ["b"])
            else:
                met = spread_join(met, of, "b", e_hot, ["a"])
        after = cut(met.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        drop(e)
        e = after
        rounds.append((up.select("node", "up"), hot))
        rounds[-1][0]._weftline_path = up._weftline_path
    if not rounds:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    root, _ = rounds[-1]
    for up, hot in reversed(rounds[:-1]):
        below = root.select(F.col("node").alias("up"), F.col("up").alias("root"))
        followed = spread_join(up, below, "up", hot.withColumnRenamed("node", "up") if hot is not None else None, ["node"], "left")
        found = cut(followed.select("node", F.coalesce("root", "up").alias("up")), "roots")
        drop(root, up)
        root = found
    least = root.groupBy("up").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n"))
    hot = None
    if any(h is not None for _, h in rounds) or len(rounds) > 1:
        least = cut(least, "names")
        hot = hot_keys(least, "up")
    out = cut(spread_join(root, least.drop("n"), "up", hot, ["node"]).select("node", "component"), "components")
    drop(root, least)
    return out


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of what ``comp`` joins already and ``links`` (a, b) join further.

    Only the links between components are worked through again.
    """
    name = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    met = links.select("a", "b")
    for end, other in (("a", "b"), ("b", "a")):
        sizes = met.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
        met = spread_join(met, name(end), end, hot_keys(sizes, end), [other], "left")
    joined = components(met.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    new = joined.join(comp.select("node"), "node", "left_anti")
    names = joined.select(F.col("node").alias("component"), F.col("component").alias("name"))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))  # counted inside tasks first
    known = spread_join(comp, names, "component", hot_keys(sizes, "component"), ["node"], "left").select("node", F.coalesce("name", "component").alias("component"))
    return cut(known.unionByName(new), "components")
