import pytest
from pyspark.sql import functions as F

from sidelight.functions import dates, sidecar


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def parts(x):
    return None if x is None else (x.year, x.month, x.day)


@pytest.mark.parametrize("stem, want", [
    ("IMG_20150407_123456", (2015, 4, 7)), ("2019-08-30 21.04.11", (2019, 8, 30)), ("IMG_20151345_000000", None), ("DSCF0841", None), ("120150407", None), ("2015_04-07", (2015, 4, 7)),
])
def test_from_filename(spark, stem, want):
    assert parts(one(spark, dates.from_filename(F.lit(stem)))) == want


@pytest.mark.parametrize("folders, want", [
    (["2017, 4-8 may. trip to the coast"], (2017, 5, 4)), (["др (январь 2024)"], (2024, 1, None)), (["2019", "august, seaside"], (2019, 8, None)),
    (["2017 may. trip to the coast"], (2017, 5, None)), (["marbella trip"], None), (["separate scans"], None), ([], None), (["12 мая", "2018"], (2018, 5, 12)),
    (["4 May 2017", "June"], (2017, 6, None)), (["summer 2015"], (2015, None, None)), (["december trip, january return"], (None, 12, None)),
])
def test_from_folders(spark, folders, want):
    assert parts(one(spark, dates.from_folders(F.array(*map(F.lit, folders)).cast("array<string>")))) == want


@pytest.mark.parametrize("query, want", [
    ("trip 12.05.2017", (2017, [5], 12)), ("2017-05-12 at the sea", (2017, [5], 12)), ("May 12, 2017", (2017, [5], 12)), ("фото 12 мая 2017", (2017, [5], 12)),
    ("photos from last summer", (None, [6, 7, 8], None)), ("photos from 2020", (2020, None, None)), ("just a holiday by the sea", None), ("", None), (None, None),
    ("31.13.2017", (2017, None, None)), ("day 12", None), ("зимой 2016", (2016, [12, 1, 2], None)),
])
def test_parse_query(spark, query, want):
    x = one(spark, dates.parse_query(F.lit(query).cast("string")))
    assert (None if x is None else (x.year, x.months, x.day)) == want


@pytest.mark.parametrize("y, m, d, want", [(2017, 5, 12, "12 May 2017"), (2017, 5, None, "May 2017"), (2017, None, None, "2017"), (None, 8, None, "August"), (None, None, None, None)])
def test_label(spark, y, m, d, want):
    date = F.struct(F.lit(y).cast("int").alias("year"), F.lit(m).cast("int").alias("month"), F.lit(d).cast("int").alias("day"))
    assert one(spark, dates.date_label(date)) == want


@pytest.mark.parametrize("content, path, want", [
    ('<x exif:DateTimeOriginal="2020-05-12T10:00"/>', "/r/2017 June/IMG_20150407.jpg", (2020, 5, 12, "exif")),
    ('<x exif:DateTimeOriginal="1699-05-12" xmp:CreateDate="2001-01-01"/>', "/r/2017 June/IMG_20150407.jpg", (2015, 4, 7, "filename")),
    ("", "/r/2017/4-8 May/a.jpg", (2017, 5, 4, "folder")), ("", "/elsewhere/2017/a.jpg", None), ("", "/r/a.jpg", None), ('<x xmp:CreateDate="2001-02-31"/>', "/r/a.jpg", (2001, 2, 31, "exif")),
])
def test_chain(spark, content, path, want):
    p = F.lit(path)
    x = one(spark, dates.date_chain(F.lit(content), sidecar.file_stem(p), sidecar.folders(p, "/r")))
    assert (None if x is None else tuple(x)) == want
