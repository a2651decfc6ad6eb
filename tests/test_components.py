import random

import pytest

from sidelight.operators.components import connected_components
from sidelight.workspace import Workspace


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "empty", "loops"])
def test_components_match_union_find(spark, kind):
    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(100, i) for i in range(50)],
        "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(70)],
        "empty": [],
        "loops": [(1, 1), (2, 3), (3, 2), (None, 4), (5, None)],
    }[kind]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in connected_components(df, Workspace(spark, "t")).collect()}
    assert got == union_find(edges)
