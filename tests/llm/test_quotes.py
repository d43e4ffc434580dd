import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import quotes as q
from weftline.operators import skew

ROWS = [
    (1, 0, "user", "Hello there my friend\nhow are you today"),
    (1, 1, "assistant", "> hello there MY friend\n\nI am fine thanks a lot"),
    (1, 2, "user", "On Monday X wrote:\n> I am fine thanks a lot\n>> hello there my friend\nGood to hear that news"),
    (1, 3, "user", "> how are you today\nanswering the second line here"),
    (1, 4, "assistant", "next one plain"),
    (1, 5, "user", "> good to hear that news\nlate reply"),
    (2, 0, "user", None),
    (2, 3, "assistant", ""),
    (2, 3, "user", "> never said by anyone\ndup turn here"),
    (2, 3, "user", "> never said by anyone\ndup turn here"),
]


def test_levels_and_bodies():
    body, passages = q.levels("a\n> b\n> c\n>> d\n> e\nf")
    assert body == "a\nf"
    assert passages == [(1, "b\nc"), (2, "d"), (1, "e")]
    assert q.levels(None) == ("", []) and q.levels("") == ("", [])


def test_reply_order(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    rows = q.link_quotes(df).orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.turn, r.reply_to, r.n_linked) for r in rows] == [
        (1, 0, None, 0), (1, 1, 0, 1), (1, 2, 1, 2), (1, 5, 2, 1), (1, 3, 0, 1), (1, 4, 3, 0), (2, 0, None, 0), (2, 3, 0, 0), (2, 3, 3, 0),
    ]
    assert not any(">" in r.body for r in rows) and rows[2].body == "Good to hear that news"


def test_preorder_equals_a_walk(spark, monkeypatch):
    monkeypatch.setattr(q, "CHUNK", 4)
    rng = random.Random(6)
    tree = {c: {k: (None if k == 0 else rng.randrange(k)) for k in range(n)} for c, n in ((1, 40), (2, 1), (3, 25))}
    rows = [(str(c), k, p) for c, t in tree.items() for k, p in t.items()]
    got = {(int(r.conv), r.idx): r.position for r in q.preorder(spark.createDataFrame(rows, "conv string, idx long, parent long")).collect()}
    want = {}
    for c, t in tree.items():
        order = []

        def walk(k):
            order.append(k)
            for x in sorted(t):
                if t[x] == k:
                    walk(x)

        walk(0)
        want |= {(c, k): n for n, k in enumerate(order)}
    assert got == want


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(*r, 5) for r in ROWS], "conv_id long, turn long, role string, text string, position int")
    assert q.link_quotes(df).count() == 9
    assert q.link_quotes(df.where("false")).count() == 0


def test_many_messages_on_one_null_turn_stay_before_the_next(spark):
    rows = [(1, None, "user", f"message {k}") for k in range(3000)] + [(1, t, "user", f"turn {t}") for t in range(5)]
    got = q.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("position").collect()
    assert [r.position for r in got] == list(range(3005))
    assert [r.turn for r in got] == [None] * 3000 + list(range(5))
    assert [r.reply_to for r in got[3000:]] == [None, 0, 1, 2, 3]


def test_a_conversation_of_many_turns_is_cut_by_ranges(spark):
    rows = spark.range(100_000).selectExpr("'1' as conv", "id * 5000 as turn", "'user' as role", "concat('m', id) as text")
    one = q.numbered(rows.unionByName(spark.createDataFrame([("2", 3, "user", "x"), ("2", 1, "user", "y")], rows.schema)))
    assert one.where("conv = 1 and idx * 5000 = turn").count() == 100_000
    assert [r.turn for r in one.where("conv = 2").orderBy("idx").collect()] == [1, 3]


def threads(seed, conversations=6, messages=45):
    """Random threads: some quote earlier messages (whole, in part, nested), some have no ids or turns."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for c in range(conversations):
        said = []
        for k in range(messages if c else 4 * messages):  # the first one is hot
            paragraphs = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(1, 4))]
            text = rng.choice(["\n", "\n\n"]).join(paragraphs)
            if said and rng.random() < 0.5:
                source = rng.choice(said) if rng.random() < 0.7 else said[0]
                part = source if rng.random() < 0.4 else rng.choice(source.split("\n"))
                text = "\n".join("> " + line.upper() for line in part.split("\n")) + "\n" + text
            if rng.random() < 0.1:
                text = rng.choice([None, "", "> nobody ever said this here\nplain"])
            said.append(text or "")
            turn = None if rng.random() < 0.05 else k // 3 if rng.random() < 0.3 else k
            rows.append((None if c == 3 else c, turn, rng.choice(["user", "assistant"]), text))
    return rows + rows[:5]


def linked_by_hand(rows, hashed):
    """(conv, turn, role, reply_to, position, n_linked, body) of every distinct message."""
    out = []
    for c in {r[0] for r in rows}:
        own = sorted({r for r in rows if r[0] == c}, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashed[r[3]], r[3] or ""))
        wrote, parents, linked, bodies = {}, [], [], []
        for k, (_, _, _, text) in enumerate(own):
            body, passages = q.levels(text)
            bodies.append(body)
            hits = {}
            for level, passage in passages:
                for _, h in q.parts(passage):
                    if h in wrote:
                        hits[h] = min(hits.get(h, (9, 0)), (level, -wrote[h]))
            linked.append(len(hits))
            parents.append(-min(hits.values())[1] if hits else k - 1)
            for _, h in q.parts(body):
                wrote.setdefault(h, k)
        order, stack = [], [0] if own else []
        while stack:
            k = stack.pop()
            order.append(k)
            stack += sorted((x for x in range(len(own)) if parents[x] == k and x), reverse=True)
        for k, r in enumerate(own):
            out.append((c, r[1], r[2], own[parents[k]][1] if k else None, order.index(k), linked[k], bodies[k]))
    return sorted(out, key=str)


@pytest.mark.parametrize("salt", [4096, 5])
def test_linking_equals_brute_force(spark, monkeypatch, salt):
    monkeypatch.setattr(skew, "PER_SALT", salt)
    rows = threads(salt)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    got = [(r.conv_id, r.turn, r.role, r.reply_to, r.position, r.n_linked, r.body) for r in q.link_quotes(df).collect()]
    assert sorted(got, key=str) == linked_by_hand(rows, hashed)


def test_no_row_without_a_conversation_is_lost(spark):
    rows = [(None, 0, "user", "a b c d"), (None, 1, "user", "> a b c d\nyes"), (5, 0, "user", "x"), (None, -1, "user", "turn minus one"), (None, None, "user", "no turn")]
    got = q.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id or -1, r.position, r.turn) for r in got if r.turn is not None) == [(-1, 1, -1), (-1, 2, 0), (-1, 3, 1), (5, 0, 0)]
    assert len(got) == 5


def test_a_very_long_message(spark):
    text = " ".join(f"word{k}" for k in range(200_000))
    rows = [(1, 0, "user", text), (1, 1, "user", f"> {text}\nagreed"), (1, 2, "user", "> word0 word1\n" * 50_000)]
    got = q.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [(r.n_linked, r.reply_to) for r in got] == [(0, None), (1, 0), (0, 1)] and got[1].body == "agreed"
