import json
from math import acos, cos, pi, sin

import pytest
from pyspark.sql import functions as F

from sidelight.operators import duplicates
from sidelight.sources import files, writers

STEP = acos(0.95)
ANGLES = {"A": [0, STEP, pi / 2], "B": [0, STEP, 2 * STEP]}


def records(spark):
    rows = [(f"{folder}/{k}.jpg", f"d{k}", [cos(a), sin(a)]) for folder, angles in ANGLES.items() for k, a in enumerate(angles)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, path string, description string, vector array<double>")
    return df.withColumn("folder", duplicates.folder_of(F.col("path")))


@pytest.mark.parametrize("threshold, least, sizes, alike", [(0.93, 2, [3, 2], [0.95, 0.95]), (0.93, 3, [3], [0.95]), (0.97, 2, [], []), (0.97, 1, [1] * 6, [None] * 6)])
def test_clusters_stay_in_their_folder(spark, threshold, least, sizes, alike):
    got = duplicates.clusters(records(spark), threshold, least).collect()
    assert [r["size"] for r in got] == sizes and [r.avg_similarity for r in got] == alike


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_blocks_and_join_find_the_same_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(duplicates, "BLOCK", block)
    rec = records(spark)
    a, b = (sorted((r.a, r.b, round(r.score, 9)) for r in f(rec, 0.1).collect()) for f in (duplicates.similar_pairs, duplicates.similar_pairs_joined))
    assert a == b and len(a) == 5


def test_a_large_folder_is_not_joined_row_by_row(spark):
    rec = spark.range(300).select(F.col("id").alias("seq"), F.lit("f").alias("folder"), F.array(F.cos("id"), F.sin("id")).alias("vector"))
    plan = duplicates.similar_pairs_joined(rec, 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" in plan and plan.count(f"<= {duplicates.SMALL})") >= 2  # both sides of the join of rows


@pytest.mark.parametrize("small, block", [(0, 1), (0, 7), (0, 1000), (1000, 7)])
def test_joined_rows_and_blocks_find_the_same(spark, monkeypatch, small, block):
    monkeypatch.setattr(duplicates, "SMALL", small)
    monkeypatch.setattr(duplicates, "BLOCK", block)
    rows = [(k, "f" if k % 3 else "g", [cos(k), sin(k)]) for k in range(40)]
    rows += [(40, "f", None), (41, "f", [1.0, None]), (42, "f", [1.0, 0.0, 0.0]), (43, "f", [0.5, 0.5, 0.0]), (44, None, [1.0, 0.0]), (45, "g", [0.0, 0.0]), (46, "h", [1.0]), (47, "i", [])]
    rec = spark.createDataFrame(rows, "seq long, folder string, vector array<double>")
    got = sorted((r.a, r.b, round(r.score, 9)) for r in duplicates.similar_pairs_joined(rec, 0.7).collect())
    pair = [(a, b, round(cos(a - b), 9)) for a in range(40) for b in range(a + 1, 40) if (a % 3 == 0) == (b % 3 == 0) and cos(a - b) >= 0.7]
    assert got == sorted([*pair, (42, 43, round(0.5**0.5, 9))])


def test_report_is_one_file_and_read_again(spark, tmp_path):
    for _ in range(2):  # the second replaces the first
        writers.write_report(records(spark), str(tmp_path / "r.json"), 0.93)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["r.json"]
    r = files.read_report(spark, str(tmp_path / "r.json")).first()
    assert (r.threshold, r.total_photos, r.compared_pairs) == (0.93, 6, 6)
    assert [(c["size"], [p.path for p in c.photos]) for c in r.clusters] == [(3, ["B/0.jpg", "B/1.jpg", "B/2.jpg"]), (2, ["A/0.jpg", "A/1.jpg"])]
    assert json.loads((tmp_path / "r.json").read_text())["clusters"][0]["avg_similarity"] == 0.95


def test_totals(spark):
    rec = records(spark)
    assert tuple(duplicates.totals(rec, duplicates.clusters(rec, 0.93), 0.93).first()) == (0.93, 6, 6, 2, 5)


def test_alone_photos_have_no_likeness_in_the_report(spark, tmp_path):
    writers.write_report(records(spark), str(tmp_path / "r.json"), 0.97, 1)
    clusters = json.loads((tmp_path / "r.json").read_text())["clusters"]
    assert len(clusters) == 6 and all("avg_similarity" in c and c["avg_similarity"] is None for c in clusters)


def test_empty_index(spark, tmp_path):
    rec = records(spark).where("false")
    assert duplicates.clusters(rec).collect() == []
    writers.write_report(rec, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"threshold": 0.93, "total_photos": 0, "compared_pairs": 0, "clusters": []}


def test_order_of_rows_does_not_matter(spark):
    a, b = (duplicates.clusters(d, 0.93).collect() for d in (records(spark), records(spark).orderBy(F.rand(3)).repartition(3)))
    assert a == b


@pytest.mark.parametrize("path, want", [("a/b/c.jpg", "a/b"), ("c.jpg", "."), ("/c.jpg", "/"), ("/a/c.jpg", "/a")])
def test_folder(spark, path, want):
    assert spark.range(1).select(duplicates.folder_of(F.lit(path)).alias("x")).first().x == want
