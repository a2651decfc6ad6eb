import random

import pytest
from pyspark.sql import functions as F

from sidelight.llm import pivot_index as pi

SCHEMA = "vec_id long, embedding array<double>, score int"


def brute_force(rows, k):
    import math

    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in good]
    out = []
    for i, a in q:
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in q if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "clustered", "same", "few"])
def test_exact(spark, kind, monkeypatch):
    monkeypatch.setattr(pi, "BLOCK_ROWS", 64)
    rng = random.Random(kind)
    n = 4 if kind == "few" else 600
    centers = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centers)
        v = [rng.gauss(0, 0.3) for _ in range(8)] if kind == "spread" else [x + rng.gauss(0, 0.02) for x in c]
        rows.append((i, centers[0] if kind == "same" and i % 3 else v))
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = pi.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute_force(rows, 5)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [nan, 0.0]), (4, [inf, 0.0]), (None, [1.0, 1.0]), (5, [2.0, 0.5]), (50, [0.1, 0.1]), (6, [1.0, 2.0]), (6, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert sorted(map(tuple, pi.top_k(df, F.col("vec_id") % 50 == 0).collect())) == brute_force(rows, 5)


def test_empty_and_no_query(spark):
    assert pi.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []
    assert pi.top_k(spark.createDataFrame([(1, [1.0], 0)], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(500, 6)))
    index = pi.PivotIndex(x[:100])
    unit, dist = index.key(x)
    norm = np.sqrt((x * x).sum(axis=1))
    index.annuli = [(u, int((unit == u).sum()), dist[unit == u].min(), dist[unit == u].max(), norm[unit == u].max()) for u in np.unique(unit)]
    bound, scores = index.bounds(x), x @ x.T
    for k, (u, *_) in enumerate(index.annuli):
        assert (scores[:, unit == u].max(axis=1) <= bound[:, k]).all()
