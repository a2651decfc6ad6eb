import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sidelight.llm import spotsigs as sp


def marks(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r.s for r in df.select("doc_id", sp.spots(F.col("text")).alias("s")).collect()}


def plain(text):
    """Chains of two content words after an anchor, as strings."""
    import regex

    words = regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).split()
    runs, here = [], []
    for w in words:
        if w in set(sp.ANCHORS):
            runs.append(here)
            here = []
        else:
            here.append(w)
    runs.append(here)
    lead, rest = runs[0], [r for r in runs[1:]]
    squeezed = [lead] + [r for k, r in enumerate(rest) if r or k == len(rest) - 1]
    out = set()
    for k, r in enumerate(squeezed):
        if k and r:
            if len(r) >= 2:
                out.add(" ".join(r[:2]))
            elif k + 1 < len(squeezed) and squeezed[k + 1]:
                out.add(f"{r[0]} {squeezed[k + 1][0]}")
    return out or ({f"{a} {b}" for a, b in zip(words, words[1:])} if len(words) > 1 else set(words))


def test_spots_match_a_plain_version(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "Die", "und", "la", "y", "cat", "house", "Éclair", "größe", "x1", "tree.", "!!", "\n", "river,"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 40))) for _ in range(300)] + ["", None, "the", "cat", "the cat", "cat " * 30, "the " * 30, " . "]
    want = [plain(t) for t in texts]
    chains = sorted(set().union(*want))
    codes = {r.c: r.h for r in spark.createDataFrame([(c,) for c in chains], "c string").select("c", F.hash("c").alias("h")).collect()}
    got = marks(spark, texts)
    for i, w in enumerate(want):
        assert got[i] == sorted({codes[c] for c in w}), (texts[i], w)


def test_likeness_is_jaccard_above_the_floor(spark):
    rng = random.Random(5)
    rows = [(sorted(rng.sample(range(60), rng.randrange(0, 50))), sorted(rng.sample(range(60), rng.randrange(0, 50)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    for r in df.select("a", "b", sp.likeness(F.col("a"), F.col("b"), 0.4).alias("x")).collect():
        a, b = set(r.a), set(r.b)
        true = 1.0 if not a and not b else len(a & b) / len(a | b)
        assert r.x == pytest.approx(true) or r.x == 0 and true < 0.4


def neighbours(rows, hashes):
    """Rows in descending order of id (null last), then of a hash of the text; each with the next, cyclically."""
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(10**19)), hashes[r[1] or ""]))
    return [(i, t or "", (order[(k + 1) % len(order)][1] or "")) for k, (i, t) in enumerate(order)]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


HASHED = [random.Random(8).randrange(-(1 << 63), 1 << 63) for _ in range(60)]


@pytest.mark.parametrize("ids", [list(range(20)), [5], [3, 3, 7, None, 900, 100000, -4, None], list(range(0, 5000, 250)), HASHED, [4] * 40, [None] * 30])
def test_every_column_against_a_plain_version(spark, ids, tmp_path, monkeypatch):
    monkeypatch.setattr(sp, "RANGE_ROWS", 7)
    rng = random.Random(len(ids))
    texts = [rng.choice(["", None, "é" * rng.randrange(9), "a cat of the house sat on the mat " * rng.randrange(1, 4), " ".join(rng.choices(["the", "und", "cat", "haus", "x"], k=12))]) for _ in ids]
    rows = list(zip(ids, texts))
    spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, fingerprint string, key long").write.parquet(str(tmp_path / "documents.parquet"))
    hashes = {r.t: r.h for r in spark.createDataFrame([(t or "",) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    want_rows = []
    for i, t, n in neighbours(rows, hashes):
        k = len(t) // 3
        want_rows.append((i, t, n, t[: len(t) - k] + n[:k]))
    chains = sorted(set().union(*(plain(x) for r in want_rows for x in r[1:])))
    codes = {r.c: r.h for r in spark.createDataFrame([(c,) for c in chains], "c string").select("c", F.hash("c").alias("h")).collect()}
    hexed = lambda t: "".join(f"{h & 0xFFFFFFFF:08x}" for h in sorted({codes[c] for c in plain(t)}))
    want = [
        (str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(t), hexed(e), round(jaccard(plain(t), plain(e)), 9), round(jaccard(plain(t), plain(n)), 9))
        for i, t, n, e in want_rows
    ]
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in sp.op8_spotsigs(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_no_window_holds_all_rows(spark, monkeypatch):
    monkeypatch.setattr(sp, "RANGE_ROWS", 50)
    for df in (
        spark.range(3000).select(F.xxhash64("id").alias("id"), F.concat(F.lit("the cat "), F.col("id").cast("string")).alias("text")),
        spark.range(3000).select(F.lit(7).cast("long").alias("id"), F.lit("equal rows").alias("text")),
    ):
        ws = sp.Workspace(spark, "test")
        out = sp.with_next(df, ws)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
        assert out.count() == 3000
    ranged = df.select("id", "text", F.struct(F.lit(0).cast("long").alias("at"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place")).alias("key"))
    borders = sp._borders(ranged.select("key.*"), 60, 3000)
    sizes = [r["count"] for r in ranged.withColumn("range", sp._range_of(F.col("key"), borders)).groupBy("range").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 400 and len(sizes) == len(borders) + 1


def test_equal_texts_equal_fingerprints_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(["the cat sat on a mat", "other", "the cat sat on a mat"])], "doc_id long, text string").write.parquet(str(tmp_path / "a/documents.parquet"))
    rows = {r.doc_id: r for r in sp.op8_spotsigs(spark, str(tmp_path / "a")).collect()}
    assert rows[0].fingerprint == rows[2].fingerprint != rows[1].fingerprint
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "b/documents.parquet"))
    assert sp.op8_spotsigs(spark, str(tmp_path / "b")).collect() == []


def test_no_python_in_the_plan(spark):
    plan = sp.op8_spotsigs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_likeness_of_sets_of_unlike_sizes_is_exact(spark):
    df = spark.createDataFrame([([1, 2], list(range(100)))], "a array<int>, b array<int>")
    assert df.select(sp.likeness(F.col("a"), F.col("b")).alias("x")).first().x == 0.02
    assert df.select(sp.likeness(F.col("a"), F.col("b"), 0.1).alias("x")).first().x == 0.0


@pytest.mark.parametrize("floor", [0.5, 0.8, 1.0 - 1e-6])
def test_search_of_a_table_against_brute_force(spark, floor):
    rng = random.Random(14)
    words = [f"w{k}" for k in range(200)]
    base = [[rng.choice(words) for _ in range(rng.choice([2, 9, 40]))] for _ in range(6)]
    texts = [None, "", "the", "plain words only"]
    for _ in range(90):
        own = [w if rng.random() > 0.06 else rng.choice(words) for w in rng.choice(base)]
        texts.append(" ".join(x for w in own[: rng.randrange(1, len(own) + 1)] for x in (["the"] if rng.random() < 0.8 else []) + [w]))
    ids = [rng.choice([i, i, i, 5, None]) for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "c", 0.5) for i, t in zip(ids, texts)], "doc_id long, text string, id string, likeness double")
    found = marks(spark, texts)
    want: dict = {}
    for a, i in enumerate(ids):
        for b, j in enumerate(ids):
            if None not in (i, j) and i != j and i % 5 == 0 and found[a] and found[b]:
                x = jaccard(set(found[a]), set(found[b]))
                if x >= floor - 1e-12:
                    want[i, j] = max(want.get((i, j), 0), x)
    got = {(r.query_id, r.id): r.likeness for r in sp.alike(df, F.col("doc_id") % 5 == 0, floor).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 3
    assert sp.alike(df.where("false"), F.col("doc_id") % 5 == 0, floor).collect() == []
    assert "Python" not in sp.alike(df, F.col("doc_id") % 5 == 0, floor)._jdf.queryExecution().toString()
