"""Components against union and find: chains, stars, random graphs, loops, repeats and no edges."""

import random

import pytest

from tallyforge.llm.components import components

R = random.Random(1)
CASES = [[(i, i + 1) for i in range(200)], [(R.randrange(400), R.randrange(400)) for _ in range(300)], [(0, i) for i in range(1, 300)] + [(1000 + i, 500) for i in range(200)], [], [(3, 3)], [(5, 2), (2, 5), (5, 2), (-4, 5)]]


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return sorted((x, find(x)) for x in root)


@pytest.mark.parametrize("edges", CASES)
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == plain([e for e in edges if e[0] != e[1]])
