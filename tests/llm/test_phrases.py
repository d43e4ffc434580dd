import random
import re
from collections import Counter

import numpy as np
import pytest

from weftline.llm import phrases as p


def slow(rows, least, most_words, held):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for size in range(1, most_words + 1):
                for i in range(len(ws) - size + 1):
                    f[lang, tuple(ws[i : i + size])] += 1
    out = set()
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    for (lang, ws), a in candidates.items():
        inside = lambda long: any(long[i : i + len(ws)] == ws for i in range(len(long) - len(ws) + 1))  # noqa: B023, E731
        if any(o == lang and len(long) > len(ws) and 100 * b >= held * a and inside(long) for (o, long), b in candidates.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.add((lang, " ".join(ws), a, f[lang, ws[:k]], f[lang, ws[k:]], n[lang], score))
    return out


def texts(seed, n=150):
    rng = random.Random(seed)
    pool = ["the", "The", "of", "new york", "New York city", "é", "日本", "a-b", "x", "strong tea", "strong  tea", "in spite of"]
    ends = [" ", " ", " ", " ", "\t", ", ", ".", "\n", " \r\n", "!? ", "\x0b"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(pool) + rng.choice(ends) for _ in range(rng.randrange(0, 40)))) for _ in range(n)]
    return rows + [("en", None), (None, ""), ("en", " , . "), ("fr", "only once here")]


def found(df):
    return {(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize(("least", "most_words", "held"), [(10, 3, 50), (2, 4, 80), (1, 2, 50)])
def test_equals_brute_force(spark, least, most_words, held):
    rows = texts(least)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "lang string, text string, phrase string").repartition(3)
    assert found(p.collocations(docs, least, most_words, held)) == slow(rows, least, most_words, held)


def test_small_buckets_and_short_runs(spark, monkeypatch):
    monkeypatch.setattr(p, "HELD", 50)
    monkeypatch.setattr(p, "PER_BUCKET", 20)
    rows = texts(7)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert found(p.collocations(docs, 3)) == slow(rows, 3, 3, 50)


def test_very_long_text_and_empty_table(spark):
    rows = [("en", "one two three. " * 40_000 + "w" * 100_000 + " one two")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found(p.collocations(docs)) == {("en", "one two three", 40_000, 40_001, 40_000, 120_003, 1_000_000 * 40_000 * 40_000 // (40_001 * 40_000))}
    assert found(p.collocations(docs.limit(0))) == set()


def test_scores_pass_64_bits(spark):
    a = 3_000_000_000
    grams = spark.createDataFrame([("en", "x", 1, a + 5), ("en", "y", 1, a + 1), ("en", "x y", 2, a)], "lang string, phrase string, size int, f long")
    r = p._streams(grams, 3).where("size = 2").select(p._best_cut(3).alias("c")).select("c.*").first()
    assert (r.score, r.k, r.l, r.r) == (1_000_000 * a * a // ((a + 5) * (a + 1)), 1, a + 5, a + 1)


def test_windows_stay_inside_pieces_and_texts():
    raw = "New york\tcity.new; york a".encode() + b"b c"
    w = p.Windows(raw, np.array([0, len(raw) - 3, len(raw)]), np.array([1, 1], np.uint64))
    pairs = np.flatnonzero(w._longer(np.ones(len(w.h), bool), 2))
    assert w.phrases(pairs, 2).to_pylist() == ["new york", "york city", "york a", "b c"]
    assert w.owner.tolist() == [0, 0, 0, 0, 0, 0, 1, 1]
