import random
import zlib

import numpy as np
import pytest

from sidelight.llm import langid

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    """Grams as strings, to hold the hashed and piecewise counting against."""
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in s:
        s = s.replace("  ", " ")
    return sorted(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))


def test_counting_by_pieces_and_of_all_grams(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices("abcÉñ ß!\n0", k=3000))
    whole, letters = langid.ngram_counts(text)
    assert whole.sum() == len(plain_counts(text)) and letters == sum(c.isalpha() for c in text.lower())
    for piece in (1, 2, 5, 97, 2999):
        monkeypatch.setattr(langid, "_PIECE", piece)
        again, n = langid.ngram_counts(text)
        assert n == letters and np.array_equal(again, whole)


@pytest.fixture(scope="module")
def result(spark):
    return langid.op9_langid(spark, SF).collect()


def test_held_out_accuracy(spark, result):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in result if r.held_out]
    assert len(result) == len(truth) and len(held) > 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in result)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in result)
    assert sum(r.rejected for r in result) < 0.01 * len(result)


def test_learning_reads_no_held_out_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    lied = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (langid.fit_centroids(d.where(~langid.held_out(F.col("doc_id")))) for d in (docs, lied))
    assert a.languages == b.languages and np.allclose(a.vectors, b.vectors)


def fitted(spark, samples):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in samples.items() for t in ts)]
    return langid.fit_centroids(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def grams(text):
    """Hashed counts by the stated rule, gram by gram."""
    from collections import Counter

    mask = (1 << 32) - 1

    def code(gram):
        a = [ord(c) * 0x9E3779B1 & mask for c in gram]
        two = lambda x, y: ((x ^ 0x5BD1E995) * 0x85EBCA6B + y) & mask
        h = a[0] if len(a) == 1 else two(*a[:2])
        if len(a) == 3:
            h = ((h ^ h >> 15) * 0xC2B2AE35 + a[2]) & mask
        return ((h ^ h >> 13) * 0x27D4EB2F & mask) >> 19

    return Counter(map(code, plain_counts(text)))


def test_every_column_against_a_plain_version(spark, docs):
    """TF-IDF vectors, centroids, cosines and rejection written out; one centroid a language, so that clustering is a mean."""
    rng = random.Random(21)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randrange(2, 6))) for _ in range(rng.randrange(4, 40)))
    labelled = [(text("abcdeé"), "a") for _ in range(40)] + [(text("defgh"), "b") for _ in range(40)]
    seen = [grams(t) for t, _ in labelled]
    idf = lambda g: np.log((1 + len(seen)) / (1 + sum(g in s for s in seen))) + 0.1
    weight = {g: idf(g) for g in set().union(*seen)}

    def vector(counts):
        v = np.zeros(langid.BUCKETS)
        for g, n in counts.items():
            v[g] = np.log1p(n) * weight.get(g, np.log(1 + len(seen)) + 0.1)
        return v / max(1e-12, np.linalg.norm(v))

    mean = {}
    for lang in "ab":
        m = sum(vector(s) for s, (_, own) in zip(seen, labelled) if own == lang)
        mean[lang] = m / np.linalg.norm(m)
    own = sorted(int(min(1, mean[lang] @ vector(s)) * 10_000) for s, (_, lang) in zip(seen, labelled))
    asked = [text("abcdeé"), text("defgh"), text("xyz"), text("abcdefgh"), "ab", "", None, "12 !"]
    before = langid.CENTROIDS
    langid.CENTROIDS = 1
    try:
        model = langid.fit_centroids(spark.createDataFrame([(i, *r) for i, r in enumerate(labelled)], "doc_id long, text string, lang string"))
    finally:
        langid.CENTROIDS = before
    rows = {r.doc_id: r for r in langid.with_language(docs(asked), model).collect()}
    shortest = min(sum(c.isalpha() for c in t).bit_length() for t, _ in labelled)
    for i, t in enumerate(asked):
        r = rows[i]
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        cosines = {lang: float(m @ vector(grams(t))) for lang, m in mean.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert r.lang_pred == best and r.score == pytest.approx(max(0, cosines[best]), abs=1e-4)
        letters = sum(c.isalpha() for c in t).bit_length()
        # fewer than POOL labelled rows are one class, whose quantile is the lowest cosine
        assert r.rejected == (letters >= shortest and cosines[best] < langid.SLACK * own[0] / 10_000)


def test_learning_is_bounded_and_of_distinct_rows(spark, monkeypatch):
    rows = [(i % 7, f"cat {i % 7}", "en") for i in range(300)] + [(1000 + i, f"hund {'ab'[i % 2] * (i % 40)}", "de") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    monkeypatch.setattr(langid, "TRAIN_ROWS", 50)
    n = {r.lang: r["count"] for r in langid._sample(df, {"en": 300, "de": 400}).groupBy("lang").count().collect()}
    assert n["en"] <= 7 and 30 < n["de"] <= 50
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.fit_centroids(df.withColumnRenamed("id", "doc_id"))


def test_defined_cases(spark, docs):
    model = fitted(spark, {"en": ["the cat sat on the mat " * 3] * 4, "de": ["der hund und die katze " * 3] * 4})
    df = docs([None, "", "12 %% 3", "the cat", "der hund", "the cat"]).withColumnRenamed("kept", "score")
    out = langid.with_language(df, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score", "rejected"]
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in out.collect()}
    assert [got[i] for i in range(3)] == [("und", True)] * 3
    assert got[3] == got[5] and got[3][0] == "en" and got[4][0] == "de"
    assert langid.with_language(docs([]), model).collect() == []


def test_without_learning_rows(spark, docs):
    empty = langid.fit_centroids(docs([]))
    assert [r.lang_pred for r in langid.with_language(docs(["text"]), empty).collect()] == ["und"]


def test_far_texts_are_rejected(spark, docs):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choices(letters, k=5))
    model = fitted(spark, {"a": [" ".join(word("abcde") for _ in range(60)) for _ in range(30)], "b": [" ".join(word("fghij") for _ in range(60)) for _ in range(30)]})
    near, far = " ".join(word("abcde") for _ in range(60)), " ".join(word("uvwxyz") for _ in range(60))
    assert [r.rejected for r in sorted(langid.with_language(docs([near, far]), model).collect())] == [False, True]


def test_thresholds_are_of_all_labelled_rows(spark):
    rng = random.Random(4)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(rng.randrange(20, 80)))
    n = langid.TRAIN_ROWS + 300
    rows = [(text("abcdefg"), "a") for _ in range(n)] + [(text("hijklmn"), "b") for _ in range(n)]
    odd = set(range(0, 2 * n, 2 * n // 12))
    scripts = [0x391, 0x430, 0x531, 0x5D0, 0x621, 0x905, 0xE01, 0x10D0, 0x13A0, 0x1401, 0x3041, 0xAC00, 0xA000]
    for i, at in zip(sorted(odd), scripts):
        rows[i] = (text([chr(at + k) for k in range(7)]), rows[i][1])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(4)
    out = langid.with_language(df, langid.fit_centroids(df)).collect()
    assert len(out) == 2 * n and {r.doc_id for r in out if r.rejected} == odd
    assert all(r.lang_pred == r.lang for r in out if r.doc_id not in odd)


def test_small_classes_are_pooled():
    few, many = [(2, 100, 1)], [(5, 9000 + i, 2) for i in range(500)]
    low = langid._low(few + many)
    assert low[:2] == [0.0] * 2 and low[2:] == [0.9004] * 30
    # what is left at the long end is one with those before
    assert langid._low(many + [(9, 50, 3)])[9] == langid._low(many + [(9, 50, 3)])[5] > 0.9
    assert langid._low([]) == [0.0] * 32
