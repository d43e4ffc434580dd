import random
import re
from collections import defaultdict

import numpy as np
import pytest

from weftline.llm import jaccard_join as j
from weftline.llm import lists

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    """(n_shingles, component) of each row index."""
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    least = defaultdict(list)
    for k in range(len(rows)):
        least[find(k)].append(rows[k][0])
    return sorted((rows[k][0], len(sets[k]), min(least[find(k)])) for k in range(len(rows)))


def corpus(seed, groups=12, size=9):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["the", "of", "and"] * 60
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(4, 140))]
        for _ in range(rng.randrange(1, size)):
            t = list(base)
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append(" ".join(t))
    rows += ["", None, "  \n ", "one", "One", "two words", "TWO\twords", rows[0], rows[0], rows[1].upper()]
    rng.shuffle(rows)
    return [(k * 3 + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("n,percent,seed", [(3, 90, 1), (5, 80, 2)])
def test_components_equal_brute_force(spark, n, percent, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(map(tuple, j.jaccard_components(df, n, percent).collect()))
    assert got == brute(rows, n, percent)


def test_long_lists_and_cells(spark, monkeypatch):
    """A dense group near the threshold, with lists cut in cells and worked in rounds."""
    monkeypatch.setattr(lists, "SHORT_LIST", 3)
    monkeypatch.setattr(lists, "LEADERS", 2)
    monkeypatch.setattr(j, "LIST_BLOCK", 6)
    rng = random.Random(5)
    base = [f"v{k}" for k in range(60)]
    rows = []
    for k in range(70):
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(60)] = f"n{rng.randrange(9)}"
        rows.append((k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, j.jaccard_components(df, 3, 90).collect())) == brute(rows, 3, 90)


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert j.jaccard_components(empty).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (2, "A b  c d")]
    got = j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(2, 2, 2), (5, 2, 2), (5, 2, 2)]


def test_heavy_shingles_meet_leaders_undivided_and_are_then_dealt(spark, monkeypatch):
    """Every list counts as too long: leaders first, cells for what they leave."""
    monkeypatch.setattr(j, "LIST_BLOCK", 4)
    monkeypatch.setattr(lists, "SHORT_LIST", 3)
    rows = corpus(7, groups=8, size=14)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, j.jaccard_components(df, 3, 90).collect())) == brute(rows, 3, 90)


def test_null_ids_and_long_texts(spark):
    text = " ".join(f"w{k % 5000}x{k}" for k in range(200_000))
    rows = [(1, text), (2, text + " end"), (None, text), (None, "only here and nowhere else"), (None, None)]
    got = j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == sorted([(1, 199_998, 1), (2, 199_999, 1), (-1, 199_998, 1), (-1, 3, -1), (-1, 0, -1)])


def test_skipping_keeps_what_a_scan_finds():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 2**63, 90, dtype=np.uint64) for _ in range(3)]
    sets = []
    for _ in range(120):
        own = np.unique(np.concatenate([rng.choice(base[rng.integers(3)], rng.integers(60, 90), replace=False), rng.integers(0, 2**63, rng.integers(0, 4), dtype=np.uint64)]))
        sets.append(own)
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), k % 7))
    marks = np.zeros((len(sets), lists.WORDS * 64), bool)
    for r, k in enumerate(order):
        marks[r, (sets[k] & np.uint64(lists.WORDS * 64 - 1)).astype(np.int64)] = True
    at = np.array([(len(sets[k]) << 32) + (k % 7) * 4 + 2 for k in order], np.int64)
    cols = {"sid": np.arange(120), "comp": np.arange(120) % 50, "at": at, "marks": [m.tobytes() for m in np.packbits(marks, axis=1)]}
    rows = lists._List(cols, 0, 120, 80)
    for h in range(120):
        j_ = np.arange(h + 1, 120)
        j_ = j_[(cols["comp"][j_] != cols["comp"][h]) & lists._fits(rows.size[h], rows.pos[h], rows.size[j_], rows.pos[j_], 80)]
        total = rows.size[h] + rows.size[j_]
        want = j_[rows.distance(h, j_) <= total - 2 * lists.needed_overlap(total, 80)]
        assert sorted(rows.likely(h, h + 1)) == sorted(want)


def test_bounds():
    size, pos = np.array([20, 20]), np.array([0, 3])
    assert list(lists._fits(np.int64(20), np.int64(0), size, pos, 90)) == [True, False]
