"""Chat formatting by quotation linking.

1. Every message is parsed into quote levels (the number of ``>`` marks that a
   line starts with).  Level 0 is what its author wrote; headers that announce a
   quote ("On ... wrote:") go with the quote.
2. Quoted passages, their paragraphs and their lines are normalised (case, white
   space) and hashed; so are each message's own text, paragraphs and lines.
3. A join by conversation and hash finds the original of a passage: the first
   message that wrote it, if that is an earlier one.  A message replies to the
   original of its shallowest linked passage (the latest, if there are several);
   without one, to the message before.
4. Conversations come out in reply order: every message after the one it replies
   to, its replies right behind it (preorder), siblings by turn, with no quotes.

A conversation, or the messages of one turn, are never gathered in one task: messages
are sorted by ranges that samples set, and places in them are counted; the order of a
conversation that branches comes from list ranking along its Euler tour, in a number of
rounds that grows with the logarithm of its length.  Joins spread a passage that very
many messages quote, a message that very many reply to, and a very long conversation.

Edge cases: null or empty texts are messages without quotes and an empty body; rows
without a conversation id are one conversation, null turns come first; rows equal in
conversation and turn are ranked by role and text, equal rows count once.  Passages of
fewer than ``MIN_WORDS`` words link nothing.  Quotes without an original are dropped
from the body all the same.  Texts are parsed whole.  Only the columns named by
``link_quotes`` come out; others of the input are left out.  An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, spread_join
from .scratch import cut, drop, table

MIN_WORDS = 3
CHUNK = 1024
_QUOTED = re.compile(r"^\s*((?:>\s?)+)(.*)$")
_HEADER = re.compile(r"(?i)^\s*(?:(?:on|am|le|el)\b.*(?:wrote|schrieb|écrit|escribió)\s*:|-+\s*original message\s*-+)\s*$")


def levels(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The body without quotes, and the quoted passages as (level, text)."""
    body: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        if m := _QUOTED.match(line):
            level = m[1].count(">")
            if last == 0:  # the header right above belongs to the quote
                while body and not body[-1].strip():
                    body.pop()
                if body and _HEADER.match(body[-1]):
                    body.pop()
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(m[2])
            last = level
        else:
            body.append(line)
            last = 0
    return "\n".join(body).strip("\n"), [(n, "\n".join(p)) for n, p in passages]


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def parts(text: str) -> list[tuple[int, int]]:
    """(grain, hash) of a text: whole 0, paragraphs 1, lines 2; short ones left out."""
    out: dict[int, int] = {}
    grains = ([text], re.split(r"\n\s*\n", text), text.split("\n"))
    for grain, pieces in enumerate(grains):
        for piece in pieces:
            clean = normal(piece)
            if clean.count(" ") + 1 >= MIN_WORDS and clean:
                h = xxhash.xxh3_64_intdigest(clean)
                out.setdefault(h - 2**64 if h >= 2**63 else h, grain)
    return [(g, h) for h, g in out.items()]


def ranked(rows: DataFrame, keys: list[str], order: str, index: str, following: str) -> DataFrame:
    """Each row's place among its keys, and the next row's order value; in chunks."""
    rows = rows.withColumn("__chunk", F.floor(F.col(order) / CHUNK))
    sums = rows.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
    run = W.partitionBy(*keys).orderBy("__chunk")
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("__then", F.lead("__first").over(run))
    mine = W.partitionBy(*keys, "__chunk").orderBy(order)
    out = rows.withColumn("__row", F.row_number().over(mine) - 1).withColumn("__lead", F.lead(order).over(mine))
    out = out.join(sums.select(*keys, "__chunk", "__before", "__then"), [*keys, "__chunk"])
    out = out.withColumn(index, F.col("__before") + F.col("__row")).withColumn(following, F.coalesce("__lead", "__then"))
    return out.drop("__chunk", "__row", "__lead", "__before", "__then")


def numbered(messages: DataFrame) -> DataFrame:
    """``messages`` with ``idx``, their place in their conversation by turn, role and text.

    The sort's ranges cut conversations and turns anywhere; a conversation's rows in
    a range lie together, so their running numbers give its places.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "role", F.xxhash64("text")]
    rows = messages.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows = cut(rows.withColumn("__at", F.monotonically_increasing_id()), "sorted").withColumn("__range", F.shiftrightunsigned("__at", 33))
    sums = rows.groupBy("conv", "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    run = W.partitionBy("conv").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv", "__range", (F.coalesce(F.sum("__n").over(run), F.lit(0)) - F.col("__first")).alias("__shift"))
    return rows.join(sums, ["conv", "__range"]).withColumn("idx", F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own_type = pa.list_(pa.int64())
    for batch in batches:
        bodies, own, quoted, counts = [], [], [], []
        for text in batch.column(2):
            body, passages = levels(text.as_py())
            bodies.append(body)
            own.append([h for _, h in parts(body)])
            quoted.append([{"level": n, "grain": g, "h": h} for n, p in passages for g, h in parts(p)])
            counts.append(len(passages))
        kind = pa.list_(pa.struct([("level", pa.int32()), ("grain", pa.int32()), ("h", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.string()), pa.array(own, own_type), pa.array(quoted, kind), pa.array(counts, pa.int32())], names=["conv", "idx", "body", "own", "quoted", "n_quotes"])


def preorder(tree: DataFrame) -> DataFrame:
    """(conv, idx, position) of trees given as (conv, idx, parent)."""
    child = ranked(tree.where("parent is not null"), ["conv", "parent"], "idx", "nth", "sibling").select("conv", "idx", "sibling")
    first = tree.where("parent is not null").groupBy("conv", F.col("parent").alias("idx")).agg(F.min("idx").alias("first"))
    t = tree.join(child, ["conv", "idx"], "left").join(first, ["conv", "idx"], "left")
    # entering a message is event 2 * idx, leaving it 2 * idx + 1
    enter = F.struct((F.col("idx") * 2).alias("e"), F.coalesce(F.col("first") * 2, F.col("idx") * 2 + 1).alias("to"), F.lit(1).cast("long").alias("d"))
    leave = F.struct((F.col("idx") * 2 + 1).alias("e"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("to"), F.lit(0).cast("long").alias("d"))
    now = cut(t.select("conv", F.explode(F.array(enter, leave)).alias("x")).select("conv", "x.e", "x.to", "x.d"), "tour")
    while not now.where("to is not null").isEmpty():
        # events that have arrived need no partner, so their null keys are kept apart
        then = now.select("conv", F.col("e").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        moved = now.where("to is not null").join(then, ["conv", "to"], "left").select("conv", "e", F.col("to2").alias("to"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"))
        after = cut(moved.unionByName(now.where("to is null").select("conv", "e", "to", "d")), "tour")
        drop(now)
        now = after
    size = cut(tree.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "sizes")
    placed = spread_join(now.where("e % 2 = 0"), size, "conv", hot_keys(size, "conv"), ["e"])
    return placed.select("conv", (F.col("e") / 2).cast("long").alias("idx"), (F.col("n") - F.col("d")).alias("position"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reply_to, position, n_quotes, n_linked, body) per message."""
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text")).distinct()
    # one key that is never null
    m = m.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    m = cut(numbered(m), "messages")
    parsed = cut(m.select("conv", "idx", "text").mapInArrow(_parse, "conv string, idx long, body string, own array<long>, quoted array<struct<level:int,grain:int,h:long>>, n_quotes int"), "parsed")

    asked = parsed.where("size(quoted) > 0").select("conv", "idx", F.explode("quoted").alias("q")).select("conv", "idx", "q.level", "q.grain", "q.h")
    wrote = parsed.select("conv", "idx", F.explode("own").alias("h")).groupBy("conv", "h").agg(F.min("idx").alias("origin"))
    often = hot_keys(asked.groupBy("conv", "h").agg(F.count(F.lit(1)).alias("n")), ["conv", "h"])
    found = spread_join(asked, wrote, ["conv", "h"], often, ["idx"]).where("origin < idx")
    links = found.groupBy("conv", "idx").agg(F.min(F.struct(F.col("level"), (-F.col("origin")).alias("o"))).alias("best"), F.count_distinct("h").alias("n_linked"))
    links = cut(links.select("conv", "idx", (-F.col("best.o")).alias("linked"), "n_linked"), "linked")

    tree = m.select("conv", "conv_id", "idx", "turn", "role").join(links, ["conv", "idx"], "left")
    tree = cut(tree.withColumn("parent", F.coalesce("linked", F.when(F.col("idx") > 0, F.col("idx") - 1))), "tree")
    branched = cut(links.where("linked <> idx - 1").select("conv").distinct(), "branched")
    if branched.isEmpty():
        tree = tree.withColumn("position", F.col("idx"))
    else:
        size = tree.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
        order = preorder(spread_join(tree.select("conv", "idx", "parent"), branched, "conv", hot_keys(size, "conv"), ["idx"]))
        tree = tree.join(order, ["conv", "idx"], "left").withColumn("position", F.coalesce("position", "idx"))
    above = m.select("conv", F.col("idx").alias("parent"), F.col("turn").alias("reply_to"))
    replied = hot_keys(tree.where("parent is not null").groupBy("conv", "parent").agg(F.count(F.lit(1)).alias("n")), ["conv", "parent"])
    out = spread_join(tree, above, ["conv", "parent"], replied, ["idx"], "left").join(parsed.select("conv", "idx", "body", "n_quotes"), ["conv", "idx"])
    return out.select("conv_id", "turn", "role", "reply_to", F.col("position").cast("long").alias("position"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"), "body")


def op10_quote_linking(spark, sf_dir: str) -> DataFrame:
    """Every message in reply order, without quotes, with the turn it replies to."""
    return link_quotes(table(spark, sf_dir, "conversations"))
