import random

import numpy as np
import pytest

from weftline.llm import line_dedup as m


def brute(docs):
    occ = {}
    for i, t in docs:
        for k, x in m._hashes(t):
            occ[x] = min(occ.get(x, (i, k)), (i, k))
    lines = list(occ)
    sets = [m.shingles_of(x) for x in lines]
    up = list(range(len(lines)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            if m.similar(sets[a], sets[b]):
                up[find(a)] = find(b)
    keep = {}
    for k, x in enumerate(lines):
        keep[find(k)] = min(keep.get(find(k), occ[x]), occ[x])
    at = {x: k for k, x in enumerate(lines)}
    out = []
    for i, t in docs:
        if t is None:
            out.append((i, None))
            continue
        kept = [line for k, line in enumerate(t.split("\n")) if not m.normal(line) or keep[find(at[m.normal(line)])] == (i, k)]
        out.append((i, "\n".join(kept)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz    "
    lines = ["".join(rng.choice(letters) for _ in range(rng.randrange(30, 200))) for _ in range(60)]
    docs = []
    for k in range(50):
        own = []
        for _ in range(rng.randrange(1, 8)):
            line = rng.choice(lines)
            if rng.random() < 0.4:  # a near copy
                p = rng.randrange(len(line))
                line = line[:p] + "Q" + line[p + 1 :]
            own.append(rng.choice([line, line.upper(), "  " + line]))
        docs.append((k, "\n".join(own + rng.choice([[""], ["ok"], []]))))
    return docs + [(90, None), (91, ""), (92, "\n \n"), (93, "ok\nOK\nok"), (94, "é" * 30), (95, "É" * 30)]


def test_equals_brute_force_with_clashing_columns(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "a", "b", 7) for i, t in docs], "doc_id long, text string, gone string, h string, n_chars long")
    rows = m.dedup_lines(df).collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == brute(docs)
    assert all(r.gone == "a" and r.h == "b" for r in rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def dense_corpus(n, edits, seed=8):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(150))
    docs = []
    for k in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(150)] = rng.choice("XYZ")
        docs.append((k, "".join(t)))
    return docs


@pytest.mark.parametrize("block,edits", [(8, 3), (4096, 6), (8, 6)])
def test_long_lists_are_settled_by_heads_and_then_in_cells(spark, monkeypatch, block, edits):
    monkeypatch.setattr(m, "SHORT_LIST", 3)
    monkeypatch.setattr(m, "LIST_BLOCK", block)
    docs = dense_corpus(60, edits)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(r.doc_id for r in m.dedup_lines(df).collect() if r.text)
    assert kept == sorted(i for i, t in brute(docs) if t)


def groups_of(n, edges, start=None):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    return sorted(sorted(k for k in range(n) if find(k) == r) for r in {find(k) for k in range(n)})


def test_spanning_links_join_what_all_links_join():
    texts = [t for _, t in dense_corpus(30, 5, 4)]
    marks = m.signatures([m.normal(t) for t in texts])[1]
    links = m.spanning_links([m.normal(t) for t in texts], np.full(30, 2), np.arange(30), marks)
    sets = [m.shingles_of(m.normal(t)) for t in texts]
    assert all(m.similar(sets[a], sets[b]) for a, b in links)
    every = [(a, b) for a in range(30) for b in range(a) if m.similar(sets[a], sets[b])]
    assert groups_of(30, links) == groups_of(30, every)
    pairs, some = m.stars(marks)
    assert set(np.flatnonzero(some)) == {k for p in pairs for k in p}


def test_one_changed_character_links_lines_of_49_and_more(spark):
    rng = random.Random(9)
    docs = []
    for n in (49, 55, 60, 78, 120):
        line = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n - 2)) + "zz"
        docs += [line, line[: n // 2] + "Q" + line[n // 2 + 1 :]]
    short = "the quick brown fox jumps over it"
    docs += [short, short[:16] + "Q" + short[17:]]  # 33 characters: 24 of 34 shingles, both stay
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert sorted(r.doc_id for r in m.dedup_lines(df).collect() if r.text) == [0, 2, 4, 6, 8, 10, 11]


def test_long_texts_and_lines(spark):
    rng = random.Random(10)
    line = "".join(rng.choice("abcdefghijklmnop ") for _ in range(1_000_000)) + "z"
    many = "\n".join(f"{rng.random()} number {k} of many lines {rng.random()}" for k in range(20_000))
    docs = [(1, line), (2, line[:500_000] + "Q" + line[500_001:]), (3, many), (4, many), (None, "a line without an id here"), (None, "a line without an id here")]
    got = m.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, len(r.text), r.n_removed) for r in got) == [(0, 25, 0), (0, 25, 0), (1, len(line), 0), (2, 0, 1), (3, len(many), 0), (4, 0, 20_000)]


def test_empty_table_and_repeated_rows(spark):
    assert m.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "same line here\nother"), (1, "same line here\nother"), (2, "same line here")]
    got = m.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == ["", "same line here\nother", "same line here\nother"]


def test_rows_without_id_lose_lines_each_by_its_own_text(spark):
    own = [f"a line that only text {k} holds, with some more words" for k in range(300)]
    rows = [(None, f"{x}\nshared by all of them, and long enough") for x in own] + [(None, "one more first\nanother second")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = m.removals(df.union(spark.createDataFrame([(7, own[3])], df.schema)), "text", "doc_id")
    assert [(r.doc_id, len(r.gone)) for r in gone.collect()] == [(7, 1)]  # without an id, the same place is the same line
    late = spark.createDataFrame([(None, f"{x}\n{own[0]}") for x in own[1:]] + [(None, own[0])], "doc_id long, text string")
    gone = m.removals(late, "text", "doc_id").collect()
    assert max(len(r.gone) for r in gone) == 1 and len(gone) == 299


def test_pairs_just_similar_enough_share_a_band():
    rng = random.Random(12)
    pairs = []
    while len(pairs) < 2000:
        one = "".join(rng.choice("abcdefghijklmnop ") for _ in range(160))
        two = list(one)
        for _ in range(3):
            two[rng.randrange(160)] = "Z"
        a, b = m.shingles_of(one), m.shingles_of("".join(two))
        if 0.8 <= len(a & b) / len(a | b) <= 0.83:
            pairs.append((one, "".join(two)))
    keys, marks = m.signatures([x for p in pairs for x in p])
    missed = ~(keys[::2] == keys[1::2]).any(axis=1)
    assert missed.sum() <= 8  # 3 expected
    assert (m.agreeing(marks[::2], marks[1::2]) < m.AGREE).sum() <= 3
