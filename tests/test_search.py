import json
import random

import pytest
from pyspark.sql import functions as F

from sidelight.operators import search
from sidelight.schemas import INDEX_DDL

NOWHERE = ("", "", "", "")


def record(path, vector, people=(), location=None, date=None, source="photos", description="d", keywords=("k",), seq=0):
    return (path, description, list(keywords), list(people), location, date, source, vector, seq)


def index(spark, *records):
    return spark.createDataFrame([r[:-1] + (i,) for i, r in enumerate(records)], INDEX_DDL)


def found(df):
    return [(r.path, r.match_type, r.match_label) for r in df.collect()]


@pytest.mark.parametrize("query, people, want", [
    ("anna smith at the lake", ["Anna Smith", "Anna Jones"], ("Anna Smith", 2)), ("anna", ["Anna Jones", "Anna Smith"], ("Anna Jones", 1)),
    ("Марии", ["Мария Ёлкина"], ("Мария Ёлкина", 1)), ("nobody", ["Anna"], None), ("anna anna", ["Anna"], ("Anna", 2)), ("x", [], None),
])
def test_person(spark, query, people, want):
    from sidelight.functions.text import words

    names = F.array(*map(F.lit, people)).cast("array<string>")
    x = spark.range(1).select(search.match_person(search._keys(words(F.lit(query))), names, search.people_keys(names)).alias("x")).first().x
    assert (None if x is None else tuple(x)) == want


@pytest.mark.parametrize("query, place, want", [
    ("mountains in osterreich", ("Austria", "", "", ""), "Austria"), ("austria", ("Austria", "Vienna", "", ""), "Vienna"), ("australia", ("Austria", "", "", ""), "Austria"),
    ("park", ("", "", "", "Central Park"), None), ("park", ("USA", "", "", "Central Park"), "USA"), ("rome", ("Austria", "", "", ""), None), ("rome", None, None),
    ("wien", ("", "Vienna", "", ""), "Vienna"), ("tyrol", ("Austria", "", "Tyrol", ""), "Tyrol"),
])
def test_location(spark, query, place, want):
    (keys, named, _), = search._said(spark, [query], None)
    df = spark.createDataFrame([(place,)], "l struct<country:string,city:string,province:string,name:string>").withColumn("p", search.place_parts(F.col("l")))
    own = search.place_keys(F.col("p"), F.col("l.name"))
    got = df.select(search.match_location(search._strings(keys), search._strings(named), F.col("l"), F.col("p"), own).alias("x")).first().x
    assert got == want


@pytest.mark.parametrize("asked, date, want", [
    ((2017, [5], 12), (2017, 5, 12, "exif"), (0.9, "12 May 2017")), ((None, [5], None), (2017, 5, None, "folder"), (0.6, "May 2017")), ((2017, None, None), (2017, None, None, "folder"), (0.3, "2017")),
    ((None, [6, 7, 8], None), (None, 8, None, "folder"), (0.3, "August")), ((2017, [5], None), (2017, None, None, "folder"), None), ((2017, None, None), (2016, 1, 1, "exif"), None),
    (None, (2017, 1, 1, "exif"), None), ((2017, None, None), None, None),
])
def test_date(spark, asked, date, want):
    df = spark.createDataFrame([(asked, date)], "q struct<year:int,months:array<int>,day:int>, d struct<year:int,month:int,day:int,source:string>")
    x = df.select(search.match_date(F.col("q"), F.col("d")).alias("x")).first().x
    assert (None if x is None else tuple(x)) == want


def test_a_match_outranks_a_likeness(spark):
    rows = search.clean(index(spark, record("a", [1.0, 0.0], people=["Anna"]), record("b", [0.0, 1.0])))
    assert found(search.search(rows, "anna", [0.0, 1.0])) == [("a", "person", "Anna"), ("b", None, None)]


def test_scope_blank_top_and_ties(spark):
    rows = search.clean(index(spark, *(record(p, [1.0, 1.0], source=s) for p, s in [("a", "photos"), ("b", "media"), ("c", None), ("d", "photos")])))
    assert [p for p, *_ in found(search.search(rows, "x", [1.0, 0.0]))] == ["a", "c", "d"]
    assert [p for p, *_ in found(search.search(rows, "x", [1.0, 0.0], sources=("photos", "media"), top=2))] == ["a", "b"]
    assert search.search(rows, "  ", [1.0, 0.0]).collect() == [] and search.search(rows, "x", [1.0, 0.0], top=-1).collect() == []
    assert search.scope_total(rows).first().total == 3


def test_ranks_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(4)
    rows = [record(f"p{i}", [rng.gauss(0, 1) for _ in range(4)], people=[rng.choice(["Anna", "Boris"])], date=(2000 + i % 5, None, None, "folder")) for i in range(60)]
    df = index(spark, *rows)
    a, b = (found(search.search(search.clean(d), "anna 2003", [1.0, 0.0, 0.0, 0.0], top=20)) for d in (df, df.orderBy(F.rand(1)).repartition(5)))
    assert a == b


def test_zero_vectors_score_nothing(spark):
    rows = search.clean(index(spark, record("a", [0.0, 0.0]), record("b", [-1.0, 0.0])))
    assert [(r.path, round(r.score, 6)) for r in search.search(rows, "x", [1.0, 0.0]).collect()] == [("a", 0.0), ("b", -1.0)]


def test_glitched_records_are_left_out_and_counted(spark):
    df = index(spark, record("a", [1.0]), record("b", [1.0], description="猫"), record("c", [1.0], keywords=["犬"], source="media"))
    assert [p for p, *_ in found(search.search(search.clean(df), "x", [1.0]))] == ["a"]
    r = search.stats(df).first()
    assert (r.indexed, r.total, r.skipped_cjk, r.by_source) == (True, 1, 2, {"photos": 1})
    empty = search.stats(index(spark, record("a", [1.0])).where("false")).first()
    assert (empty.indexed, empty.total, empty.skipped_cjk) == (False, 0, 0)


def test_batch_equals_single_searches(spark):
    rng = random.Random(7)
    rows = search.clean(index(spark, *(record(f"p{i}", [rng.gauss(0, 1) for _ in range(3)], people=[rng.choice(["Anna", "Boris"])], source=rng.choice(["photos", "media"])) for i in range(40))))
    asked = [(0, "anna", [1.0, 0.0, 0.0], ["photos"]), (1, "boris 2017", [0.0, 1.0, 0.0], ["photos", "media"]), (2, " ", [0.0, 1.0, 0.0], ["photos"])]
    got = search.search_many(rows, spark.createDataFrame(asked, "query_id int, query string, vector array<double>, sources array<string>"), top=5).collect()
    for i, q, v, s in asked:
        want = [p for p, *_ in found(search.search(rows, q, v, top=5, sources=s))]
        assert [r.path for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] == want


def test_batch_of_all_kinds_equals_single_searches(spark, monkeypatch):
    monkeypatch.setattr(search, "_SLICE", 16)
    rng = random.Random(17)
    names, places = ["Anna Smith", "Anna Jones", "Мария Ёлкина", "Bo"], [("Austria", "Vienna", "", ""), ("Germany", "", "", "Park"), ("", "", "", "Central Park"), None, ("USA", "Rome", "Tyrol", "")]
    rows = [
        record(f"p{i}", [round(rng.gauss(0, 1), 2) for _ in range(4)] if i % 9 else [0.0] * 4, people=rng.sample(names, rng.randrange(3)), location=rng.choice(places),
               date=rng.choice([None, (2017, 5, 12, "exif"), (2017, None, None, "folder"), (None, 8, None, "folder")]), source=rng.choice(["photos", "media", None, ""]))
        for i in range(120)
    ] + [record("none", None), record("wide", [1.0] * 5)]
    df = search.clean(index(spark, *rows))
    texts = ["anna smith", "Марии in wien", "deutschland park", "12 May 2017", "summer", "2017 tyrol anna anna", "nothing", "x", " "]
    asked = [(i, t, [rng.gauss(0, 1) for _ in range(4)], rng.choice([["photos"], ["media", "photos"], ["none"]])) for i, t in enumerate(texts)] + [(99, "anna", [1.0] * 5, ["photos"])]
    got = search.search_many(df, spark.createDataFrame(asked, "query_id int, query string, vector array<double>, sources array<string>"), top=7).collect()
    columns = "path", "match_type", "match_label", "score"
    for i, q, v, s in asked:
        want = [tuple(r[c] for c in columns) for r in search.search(df, q, v, top=7, sources=s).collect()]
        have = [tuple(r[c] for c in columns) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i]
        assert [x[:3] for x in have] == [x[:3] for x in want] and [x[3] for x in have] == pytest.approx([x[3] for x in want]), q
    assert sorted(r["rank"] for r in got if r.query_id == 7) == list(range(1, 8))


def test_aliases_of_a_file_are_appended(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"Austria": ["ÖSTERREICH"], "Italy": ["Italien"]}))
    got = search.load_aliases(spark, str(tmp_path / "a.json"))
    assert got["austria"] == ["osterreich", "österreich"] and got["italy"] == ["italien"] and search.ALIASES["austria"] == ["osterreich"]


def test_printed(spark):
    rows = search.clean(index(spark, record("a", [1.0, 0.0], people=["Anna"], keywords=["x", "y"])))
    line = search.printed(search.search(rows, "anna", [1.0, 0.0])).first()
    assert (line["rank"], line.line) == (1, "2.010 [person: Anna]  a\n  d\n  x, y")


def test_a_batch_above_the_limit_is_met_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = search.clean(index(spark, *(record(f"p{i}", [rng.gauss(0, 1) for _ in range(3)]) for i in range(20))))
    asked = spark.createDataFrame([(i, "x", [rng.gauss(0, 1) for _ in range(3)], ["photos"]) for i in range(25)], "query_id int, query string, vector array<double>, sources array<string>")
    ranks = lambda: sorted((r.query_id, r["rank"], r.path) for r in search.search_many(rows, asked, top=2).collect())
    whole = ranks()
    monkeypatch.setattr(search, "MAX_BATCH", 10)
    assert len(whole) == 50 and ranks() == whole


def test_one_scan_serves_the_blocks_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_BATCH", 10)
    monkeypatch.setattr(search, "_SLICE", 16)
    rng = random.Random(9)
    rows = search.clean(index(spark, *(record(f"p{i}", [rng.gauss(0, 1) for _ in range(3)], people=[rng.choice(["Anna", "Boris"])]) for i in range(90))))
    asked = [(i, rng.choice(["anna", "x", "boris"]), [rng.gauss(0, 1) for _ in range(3)], ["photos"]) for i in range(60)]
    out = search.search_many(rows, spark.createDataFrame(asked, "query_id int, query string, vector array<double>, sources array<string>"), top=2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = out.collect()
    for i, q, v, s in asked[::6]:
        want = [(r.path, r.score) for r in search.search(rows, q, v, top=2).collect()]
        assert [(r.path, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == want


def test_equal_vectors_tie_wherever_they_stand(spark, monkeypatch):
    monkeypatch.setattr(search, "_SLICE", 37)
    rng = random.Random(10)
    few = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(3)]
    rows = search.clean(index(spark, *(record(f"p{i:03}", few[i % 3]) for i in range(150))))
    asked = [(i, "x", few[i % 3] if i < 8 else [rng.gauss(0, 1) for _ in range(64)], ["photos"]) for i in range(40)]
    got = search.search_many(rows, spark.createDataFrame(asked, "query_id int, query string, vector array<double>, sources array<string>"), top=7).collect()
    for i in range(40):
        ranks = [int(r.path[1:]) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i]
        assert ranks == list(range(ranks[0], 21, 3)) and ranks[0] < 3
