"""Connected components against a plain union-find."""

import random

import pytest

from tessaline.operators.components import connected_components

rng = random.Random(3)
CASES = {
    "none": [],
    "loop, nulls, repeats": [(1, 1), (None, 2), (3, 4), (4, 3), (3, 4)],
    "path": [(i, i + 1) for i in range(60)],
    "hub": [(0, i) for i in range(1, 50)] + [(-1, 49)],
    "random": [(rng.randrange(80), rng.randrange(80) - 40) for _ in range(70)],
}


def plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in list(parent)}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    rows = connected_components(spark.createDataFrame(CASES[name], "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == plain(CASES[name]) and len(rows) == len(plain(CASES[name]))
