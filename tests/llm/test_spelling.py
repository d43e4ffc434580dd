import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import spelling as s


def slow_words(rows, noise=s.NOISE):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_groups(words):
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def found(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def random_words(n, seed, letters="abé", low=1, high=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(low, high))): rng.randrange(1, 200) for _ in range(n)}


@pytest.mark.parametrize("most", [2048, 16, 4])
def test_groups_equal_brute_force(spark, most):
    words = random_words(700, 1) | random_words(200, 2, "xyzuvwÿ", 8, 14) | {"a" * 40: 3, "a" * 41: 9, "a" * 39 + "b": 2}
    vocab = spark.createDataFrame(list(words.items()), "word string, n int").repartition(3)
    assert found(s.group_spellings(vocab, most=most)) == slow_groups(words)


def test_each_pair_once_in_full_blocks_and_long_words(spark):
    base = "abcdefghijklmnopqrstuvwxyz" * 3_000
    words = {base[:k] + x + base[k + 1 :]: 5 for k in (0, 7, 40_000, len(base) - 1) for x in "éùñ"} | {base: 50, base + "q": 4, base[1:]: 3}
    words |= {"hotword" + a + b: 3 for a in "abcdefghij" for b in "abcdefghij"}
    vocab = spark.createDataFrame(list(words.items()), "word string, n int")
    got = [tuple(sorted((r.a, r.b))) for r in s.near_pairs(vocab, most=8).collect()]
    want = {tuple(sorted((a, b))) for a in words for b in words if a < b and is_near(a, b)}
    assert len(got) == len(want) and set(got) == want


def test_blocks_stay_small(spark):
    words = {"p" * 12 + a + b + c: 3 for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    vocab = spark.createDataFrame(list(words.items()), "word string, n int")
    sizes = s.blocks(vocab, most=32).where("hi - lo > 1").groupBy("block").count().agg(F.max("count")).first()[0]
    assert sizes <= 32


def test_query_over_texts(spark, monkeypatch):
    rng = random.Random(4)
    pool = ["Spelling", "spelling", "speling", "spellings", "École", "école", "écoles", "wörter", "wörtér", "short", "abcde", "abcdf", "ÀÀÀÀÀ"]
    rows = [(rng.choice([None, *range(40)]), " ".join(rng.choice(pool) + rng.choice(["", ".", "×", "3", "ş"]) for _ in range(rng.randrange(0, 40)))) for _ in range(120)]
    rows += [(1, None), (2, ""), (3, "lonelyword"), (5, "Spelling " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    words = slow_words(rows, 5)
    assert {(r.word, r.n) for r in s.vocabulary(docs, noise=5).collect()} == set(words.items())
    assert found(s.group_spellings(s.vocabulary(docs, noise=5))) == slow_groups(words)
    assert {(r.word, r.n) for r in s.vocabulary(docs).collect()} == set(slow_words(rows).items())
    assert found(s.group_spellings(s.vocabulary(docs.limit(0)))) == set()


def test_chains_lead_to_their_ends(spark):
    words = {"a" * (5 + k): 2**k for k in range(20)}
    vocab = spark.createDataFrame(list(words.items()), "word string, n int")
    assert {r.root for r in s.group_spellings(vocab).collect()} == {"a" * 24}
