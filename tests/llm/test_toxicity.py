"""Exact neighbours, held-out quality, defined cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import toxicity as t

VECTORS = st.lists(st.dictionaries(st.integers(0, 12), st.sampled_from([0.1, 0.25, 0.5, 1.0]), max_size=5), max_size=300)


@settings(max_examples=150, deadline=None)
@given(VECTORS, st.dictionaries(st.integers(0, 14), st.sampled_from([0.2, 0.5, 1.0]), max_size=4), st.integers(1, 9))
def test_search_is_exact(vectors, query, k):
    scores = [sum(w * v.get(f, 0) for f, w in query.items()) for v in vectors]
    want = sorted(((s, i) for i, s in enumerate(scores) if s > 0), key=lambda x: (-x[0], x[1]))
    pair = lambda v: (np.array(list(v), np.int64), np.array(list(v.values()), float))
    for short in (0, 20, 1000):
        t.SHORT = short
        found, score = t.BlockMaxIndex([pair(v) for v in vectors], 15).search([pair(query)], k)[0]
        assert np.allclose(sorted(score, reverse=True)[:k], [s for s, _ in want[:k]])
        least = want[min(k, len(want)) - 1][0] if want else 0
        assert set(found.tolist()) == {i for i, s in enumerate(scores) if s > 0 and s >= least - 1e-9}, "ties included"
        left = sorted((s for s, i in want if i % 3), reverse=True)[:k]
        found, score = t.BlockMaxIndex([pair(v) for v in vectors], 15).search([pair(query)], k, [np.arange(0, len(vectors), 3)])[0]
        assert np.allclose(sorted(score, reverse=True)[:k], left) and not any(i % 3 == 0 for i in found.tolist())


def plain_terms(text):
    out = Counter()
    for w in re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
        out[w] += 1
        for size in t.PREFIXES:
            if len(w) > size:
                out[w[:size], size] += 1
    return out


def plain_scores(docs, labels):
    """Scores of (doc_id, text) rows by the definitions, with dictionaries and all pairs."""
    usable = defaultdict(int)
    for d, y in labels:
        if d is not None and y in (0, 1) and zlib.crc32(str(d).encode()) % 4 != 2:
            usable[d] = max(usable[d], y)
    kept = {}
    for d, text in docs:
        if d in usable:
            kept[text or ""] = max(kept.get(text or "", 0), usable[d])
    texts, n = list(kept), [sum(y == z for y in kept.values()) for z in (0, 1)]
    counts = [plain_terms(x) for x in texts]
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log((len(texts) + 1) / (k + 1)) ** t.POWER for w, k in df.items() if k >= max(2, t.FLOOR * len(texts))}

    def vector(c):
        v = {w: (1 + math.log(k)) * idf[w] for w, k in c.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    vectors = [vector(c) for c in counts]
    prior = n[1] / sum(n)

    def vote(text):
        v = vector(plain_terms(text))
        near = sorted(((sum(x * o.get(w, 0) for w, x in v.items()), other) for other, o in zip(texts, vectors, strict=True) if other != (text or "")), reverse=True)[: t.NEIGHBOURS]
        total, toxic = sum(s for s, _ in near), sum(s for s, o in near if kept[o])
        return bool(v), (toxic + prior) / (total + 1)

    loo = [(vote(x), kept[x]) for x in texts]
    none = [sum(y == z for (known, _), y in loo if not known) for z in (0, 1)]
    pools = []
    for x, y in sorted((vote, y) for (known, vote), y in loo if known):
        pools.append([x, y, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    at, rate = [p[0] / p[2] for p in pools], [(p[1] + prior) / (p[2] + 1) for p in pools]
    out = []
    for _, text in docs:
        known, x = vote(text)
        out.append(0.99 * float(np.interp(x, at, rate)) + 0.01 * x if known else (none[1] + prior) / (sum(none) + 1))
    return out


def test_scores_equal_the_definitions(spark):
    docs, labels = made(spark, 300)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(1000 + i, text) for i, text in rows[:40]] + [(2000, ""), (2001, None), (None, "vilewrd"), (2002, "Étée ÉTÉE vilewrds")]
    given = [(r.doc_id, r.toxic) for r in labels.collect()] + [(1001, 1), (1002, 0), (5, None), (None, 1)]
    got = t.scored(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(given, "doc_id long, toxic int"))
    by_text = {}
    for (_, text), s in zip(rows, plain_scores(rows, given), strict=True):
        by_text[text or ""] = s
    texts = {d: text for d, text in rows}
    for r in got.collect():
        assert abs(r.score - by_text[texts[r.doc_id] or ""]) < 1e-6, "copies under other ids score alike"


def made(spark, n=600):
    r = random.Random(4)
    plain = ["stone", "river", "table", "green", "walk", "paper", "cloud", "seven", "window", "garden"]
    docs, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        w = [r.choice(plain) for _ in range(30)] + ([r.choice(["vilewrd", "grossen", "nastify"]) + r.choice(["", "s", "er"]) for _ in range(4)] if bad else [])
        r.shuffle(w)
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents(spark):
    docs, labels = made(spark)
    got = {r.doc_id: r for r in t.scored(docs, labels).collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert r.predicted == int(i % 6 == 0) and 0 <= r.score <= 1
        assert (r.score >= 0.3) == (r.predicted == 1)
        assert not any(part.split(":")[0] == str(i) for part in r.evidence.split(",")), "never its own neighbour"
        assert r.evidence
    assert sorted(r.doc_id for r in t.accepted(docs, labels).collect()) == [i for i in range(600) if i % 6]


def test_defined_cases(spark):
    docs, labels = made(spark, 240)
    odd = spark.createDataFrame([(900, None, "x"), (901, "", "x"), (902, "vilewrd " * 20_000, "x"), (None, "vilewrd grossen nastify", "x"), (902, "stone", "x")], docs.schema)
    more = spark.createDataFrame([(900, None), (None, 1), (901, 7)], "doc_id long, toxic int")
    got = {(r.doc_id, r.predicted) for r in t.scored(docs.unionByName(odd), labels.unionByName(more)).collect()}
    assert {(900, 0), (901, 0), (902, 1), (None, 1), (902, 0)} <= got
    none = labels.where("false")
    assert {r.score for r in t.scored(docs, none).collect()} == {0.0}
    assert t.accepted(docs, none).count() == docs.count()
    assert t.scored(docs.where("false"), labels).count() == 0
    assert {r.predicted for r in t.scored(docs, labels.where("toxic = 0")).collect()} == {0}


def test_driver_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = t.scored(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    toxic, flagged = [r for r in got if r.toxic == 1], [r for r in got if r.predicted == 1]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic), "recall"
    assert sum(r.toxic == 1 for r in flagged) >= 0.8 * len(flagged), "precision"
