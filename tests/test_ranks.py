import pytest
from pyspark.sql import functions as F

from sidelight.operators import ranks
from sidelight.plans import queries


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_ranks_in_ranges_are_those_of_the_whole(spark, monkeypatch, size):
    monkeypatch.setattr(ranks, "RANGE", size)
    rows = spark.range(60).select((F.col("id") * 37 % 61).alias("seq"), F.lit("x").alias("text")).repartition(3)
    got = ranks.ranked(rows, ["seq"]).orderBy("seq").collect()
    assert [r.place for r in got] == list(range(1, 61)) and [r.seq for r in got] == sorted(k * 37 % 61 for k in range(60))
    assert ranks.ranked(rows.where("false"), ["seq"]).collect() == []


def test_places_of_an_index_are_not_ranked_in_one_task(spark):
    out = queries.QUERIES["index_append"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and [r.place for r in out.orderBy("place").collect()] == list(range(1, out.count() + 1))
