"""Groups of near copies against all pairs, in small and in cut clusters."""

import random
import re

import pyarrow as pa
import pytest

from tallyforge.llm import near_duplicates as n
from tallyforge.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(docs, percent=85):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)


def corpus(seed, groups, size):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + r.choice("qrstuv")
    out = []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(60, 200))]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += ["", None, "one two", "ONE  two", "a b c d e", "a b c d e f", "  ", "x " * 3000, "X " * 2999]
    return list(enumerate(out))


@pytest.mark.parametrize("cut", [False, True])
def test_groups_equal_all_pairs(spark, monkeypatch, cut):
    if cut:
        monkeypatch.setattr(n, "CHUNK_WORDS", 600)
    docs = corpus(3, 5, 14)
    rows = [(i, t, None, "clash") for i, t in docs]
    got = n.groups(spark.createDataFrame(rows, "doc_id long, text string, set_key string, rep string").repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == plain(docs)


def test_one_large_group_cut_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(n, "CHUNK_DOCS", 20)
    docs = corpus(9, 1, 120)
    got = n.groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == plain(docs)


def test_empty_null_and_repeated(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f"), (5, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in n.groups(docs).collect()))
    assert got == [(0, 2, None, True), (3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False), (9, 0, 9, True)]
    assert n.groups(docs.where("false")).count() == 0
    assert n.unique(docs.where("doc_id IS NOT NULL")).count() == 2


def test_components(spark):
    chain = [(k, k + 1) for k in range(100)] + [(200, 210), (210, 205), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(101)}, 200: 200, 205: 200, 210: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_estimate_jaccard():
    import numpy as np

    r = np.random.default_rng(1)
    total = 0
    for _ in range(40):
        both = r.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = np.concatenate([both, r.integers(0, 1 << 63, 50, dtype=np.uint64)]), np.concatenate([both, r.integers(0, 1 << 63, 50, dtype=np.uint64)])
        total += np.mean(n.signature(a) == n.signature(b))
    assert abs(total / 40 - 300 / 400) < 0.03


def test_short_texts_are_one_shingle():
    sizes = [len(s) for s in n.shingle_sets(pa.array(["", None, "a", "a b c d", "a b c d e", "a a a a a a a"], pa.string()))]
    assert sizes == [0, 0, 1, 1, 1, 1]


def test_query(spark, sf):
    from oracles import same_rows

    from tallyforge.llm import queries

    same_rows(queries.QUERIES["op4_near_duplicates"](spark, sf), queries.ORACLES["op4_near_duplicates"], sf)


def test_a_pair_between_80_and_85_percent_links_at_80(spark):
    base = [f"w{k}" for k in range(104)]  # 100 shingles
    text = " ".join(base)
    near = " ".join([*base[:50], "x", *base[51:94], *base[95:]])
    a, b = shingles(text), shingles(near)
    assert 80 <= 100 * len(a & b) / len(a | b) < 85
    docs = spark.createDataFrame([(1, text), (2, near)], "doc_id long, text string")
    assert [r.kept for r in n.groups(docs).orderBy("doc_id").collect()] == [True, True]
    assert [r.doc_id for r in n.unique(docs, 80).collect()] == [1]
