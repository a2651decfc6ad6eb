import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidelight.llm import minhash


def plain_set(text, width=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x1c", "\x1c")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute_force(rows, percent):
    """Union-find over all pairs of documents; ids may repeat or be null."""
    sets = [(i, plain_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets), key=str)


def edited(rng, words, share):
    return [w if rng.random() > share else f"n{rng.randrange(10**6)}" for w in words]


@pytest.mark.parametrize("percent", [80, 85])
def test_matches_brute_force(spark, docs, percent):
    rng = random.Random(percent)
    texts = []
    for k in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 300]))]
        for _ in range(rng.randrange(1, 8)):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0, 0.005, 0.02, 0.05]))))
    texts += ["", None, "one", "ONE", "one two", "a b c d e", "A\tB\nc d  e", "é É", "É É", "x " * 2000, "x " * 3000]
    rng.shuffle(texts)
    got = minhash.near_duplicates(docs(texts), percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_force(list(enumerate(texts)), percent)


def test_large_near_group_goes_through_blocks(spark, docs, monkeypatch):
    """Copies edited from each other as well as from one base, in buckets cut into several blocks."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "CELL", 8)
    monkeypatch.setattr(minhash, "_STRIPE", 5)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    group = [base]
    for _ in range(70):
        group.append(edited(rng, rng.choice(group), 0.02))
    rng.shuffle(group)
    texts = [" ".join(g) for g in group]
    got = minhash.near_duplicates(docs(texts), percent=85).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_force(list(enumerate(texts)), 85)


def test_repeated_and_null_ids(spark, docs):
    text = "one two three four five six seven eight"
    rows = [(3, text), (3, "other words entirely here now"), (5, text), (None, text), (5, text), (1, "other words entirely here now")]
    got = minhash.near_duplicates(docs([t for _, t in rows], [i for i, _ in rows]), percent=85).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_force(rows, 85)


def test_ids_with_several_texts_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "CELL", 3)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(rng.randrange(12), " ".join(edited(rng, base, 0.01))) for _ in range(24)]
    got = minhash.near_duplicates(docs([t for _, t in rows], [i for i, _ in rows]), percent=80).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_force(rows, 80)


def test_empty_table(spark, docs):
    assert minhash.near_duplicates(docs([])).collect() == []


def test_drop_keeps_all_columns_and_one_of_each_group(spark, docs):
    text = "one two three four five six seven eight"
    df = docs([text, text, "something else", None, ""])
    out = minhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 3, 4]


def bucket(spark, n, alike):
    """A bucket of sets that share one band, by a template, and are unlike but for some; and their minima."""
    rng = np.random.default_rng(4)
    rows = []
    for d in range(n):
        sig = rng.integers(0, 1 << 32, minhash.MINIMA, np.uint32)
        sig[: minhash.ROWS] = 7
        if alike(d):
            sig[8:] = 9
        rows.append((d, bytearray(sig.tobytes())))
    sigs = spark.createDataFrame(rows, "doc long, sig binary")
    return sigs.select(F.lit(1).cast("long").alias("key"), F.lit(0).alias("band"), F.lit(n).cast("long").alias("n"), "doc", F.col("doc").alias("component")), sigs


def test_a_shared_template_moves_no_texts(spark, monkeypatch):
    """Texts are asked for by survivors alone, however large the bucket."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    monkeypatch.setattr(minhash, "CELL", 16)
    for n in (100, 400):
        members, sigs = bucket(spark, n, lambda d: d in (20, 21))
        assert {r.doc for r in minhash._met_sets(members, sigs, 85).collect()} == {20, 21}
        assert [tuple(r) for r in minhash._nearest_pairs(members, sigs, 85).collect()] == [(20, 21)]


def test_a_dense_bucket_gives_back_sets_and_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 64)
    monkeypatch.setattr(minhash, "CELL", 16)
    for n in (128, 256):
        members, sigs = bucket(spark, n, lambda d: True)
        assert minhash._nearest_pairs(members, sigs, 85).count() < n
        assert minhash._met_sets(members, sigs, 85).count() <= n * n // 16 + n
    linked = members.withColumn("component", F.lit(0).cast("long"))
    assert minhash._met_sets(linked, sigs, 85).count() == 0


def rows_of_joins(spark, run):
    """What ``run`` returns, and the rows that all joins of its queries made."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    spark.range(1).collect()
    bus.waitUntilEmpty()
    runs = store.executionsList()
    last, made, out = max(runs.apply(k).executionId() for k in range(runs.size())), 0, run()
    bus.waitUntilEmpty()
    runs = store.executionsList()
    for e in (runs.apply(k).executionId() for k in range(runs.size())):
        if e > last:
            nodes, values = store.planGraph(e).allNodes(), store.executionMetrics(e)
            for node in (nodes.apply(k) for k in range(nodes.size())):
                metrics = node.metrics()
                for m in (metrics.apply(k) for k in range(metrics.size())):
                    if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        made += int(values.apply(m.accumulatorId()).replace(",", ""))
    return out, made


def test_joins_make_rows_by_a_groups_size_and_not_its_square(spark, docs, monkeypatch):
    """Copies of one base that are too far from it, and from each other, for links, but pass the sequential test."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "CELL", 8)
    made = {}
    for n in (60, 240):
        texts = [" ".join(f"n{k}" if i in (5 + k % 50, 60 + k // 50) else f"w{i}" for i in range(120)) for k in range(n)]
        got, made[n] = rows_of_joins(spark, lambda: minhash.near_duplicates(docs(texts), percent=85).collect())  # noqa: B023
        assert sorted((tuple(r) for r in got), key=str) == brute_force(list(enumerate(texts)), 85)
    assert made[240] < 5 * made[60], made


def test_stated_misses_at_the_threshold():
    """The share of pairs of exactly the threshold's similarity that the sequential test or the bands lose."""
    from math import comb

    for t, sequential, bands in ((0.85, 9.9e-6, 4.3e-7), (0.80, 8.9e-6, 4.9e-5)):
        alive = {0: 1.0}  # matches so far, of pairs not yet given up
        for need in minhash.least_matches(round(100 * t)):
            after = {}
            for m, p in alive.items():
                for k in range(minhash.STEP + 1):
                    if m + k >= need:
                        after[m + k] = after.get(m + k, 0.0) + p * comb(minhash.STEP, k) * t**k * (1 - t) ** (minhash.STEP - k)
            alive = after
        assert 1 - sum(alive.values()) == pytest.approx(sequential, rel=0.02)
        assert (1 - t**minhash.ROWS) ** minhash.BANDS == pytest.approx(bands, rel=0.02)


def test_least_matches_bounds_the_posterior():
    least = minhash.least_matches(85, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 0.85 * minhash.MINIMA
    # a pair right at the threshold loses no more than the chosen share at any step
    from math import comb

    for n, m in zip(range(16, 129, 16), least):
        assert sum(comb(n, i) * 0.85**i * 0.15 ** (n - i) for i in range(m)) < 1e-4
