"""Recall and exact scores against brute force; the walk; the defined cases."""

from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import multi_index as m


def test_walk_goes_by_summed_distance():
    r = np.random.default_rng(2)
    a, b, sizes = r.random(9), r.random(7), r.integers(0, 5, (9, 7))
    cells = list(m.walk(a, b))
    sums = [a[i] + b[j] for i, j in cells]
    assert len(set(cells)) == 63 and sums == sorted(sums)


def filled(x, share, k=20):
    """The index of vectors in memory, and the cell of each."""
    size, cut = m.centroids(len(x)), x.shape[1] // 2
    index = m.Index(m.codebook(x[:, :cut], size), m.codebook(x[:, cut:], size))
    u, v, ru, rv = index.cells(x)
    rows = [SimpleNamespace(cu=a, cv=b, n=int(some.sum()), distinct=int(some.sum()), ru=ru[some].max(), rv=rv[some].max(), nq=0) for a, b in set(zip(u.tolist(), v.tolist(), strict=True)) for some in [(u == a) & (v == b)]]
    index.fill(rows, share, k)
    return index, u, v


def test_the_bound_rules_out_no_neighbour_and_clusters_need_few_cells():
    r = np.random.default_rng(7)
    middle = r.normal(size=(60, 16))
    x = middle[r.integers(0, 60, 6000)] + 0.1 * r.normal(size=(6000, 16))
    index, u, v = filled(x, 1.0)
    ranked = []
    for q in range(0, 6000, 200):
        first = set(index.plan(x[q]))
        inside = lambda cells: np.array([c in cells for c in zip(u.tolist(), v.tolist(), strict=True)])
        score = x @ x[q]
        least = np.sort(score[inside(first)])[-20]
        every = inside(first | set(index.plan(x[q], least)))
        assert every[np.argsort(-score)[:20]].all(), "with the whole table as share the search is exact"
        ranked.append(every.mean())
    assert np.mean(ranked) < 0.2


def brute(ids, x, q, k=20):
    s = x @ x[q]
    s[q] = -np.inf
    return ids[np.lexsort((ids, -s))[:k]]


def test_recall_and_scores(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = t.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    at = {i: k for k, i in enumerate(ids.tolist())}
    got: dict = {}
    for r in m.search(t, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r
    assert sorted(got) == [i for i in sorted(ids.tolist()) if i % 20 == 0]
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        order = [(-found[k].score, found[k].vec_id) for k in range(1, 21)]
        assert order == sorted(order) and all(r.vec_id != q for r in found.values())
        assert all(abs(r.score - x[at[q]] @ x[at[r.vec_id]]) < 1e-12 for r in found.values())
        hits += len({r.vec_id for r in found.values()} & set(brute(ids, x, at[q]).tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_many_blocks_and_chunks_give_the_same(spark, sf, monkeypatch):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = sorted(tuple(r) for r in m.search(t, F.col("vec_id") % 20 == 0).collect())
    monkeypatch.setattr(m, "ENTRIES", 37)
    assert sorted(tuple(r) for r in m.search(t, F.col("vec_id") % 20 == 0).collect()) == want


def test_defined_cases(spark):
    same = [(k, [1.0, 2.0, 3.0, 4.0], "x") for k in range(30, 0, -1)]
    odd = [(100, None, "x"), (101, [0.0] * 4, "x"), (102, [1.0, None, 1.0, 1.0], "x"), (103, [float("nan"), 1.0, 1.0, 1.0], "x"), (104, [float("inf"), 1.0, 1.0, 1.0], "x"), (105, [1.0, 2.0], "x"), (140, [2.0, 3.0], "x"), (None, [1.0] * 4, "x"), (120, [1.0, 0.0, 0.0, 0.0], "x")]
    t = spark.createDataFrame([*same, *odd], "vec_id long, embedding array<double>, rank string")
    got: dict = {}
    for r in m.search(t, F.col("vec_id") % 20 == 0, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {20: [(k, 30.0) for k in range(1, 22) if k != 20][:20], 120: [(k, 1.0) for k in range(1, 21)], 140: [(105, 8.0)]}
    assert m.search(t.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = t.where("vec_id <= 3 OR vec_id = 20")
    assert m.search(few, F.col("vec_id") % 20 == 0).count() == 3, "all candidates, if fewer"


def test_few_distinct_vectors_give_all_that_there_are(spark):
    r = np.random.default_rng(5)
    for n, want in ((10, 9), (25, 20)):
        t = spark.createDataFrame([(k, x) for k, x in enumerate(r.normal(size=(n, 8)).tolist(), 20)], "vec_id long, embedding array<double>")
        assert m.search(t, F.col("vec_id") == 20).count() == want
