"""How the registered queries go about their work."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sidelight.operators import search
from sidelight.plans import queries
from sidelight.workspace import Workspace

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def sf_dir(tmp_path):
    """A folder that no query of this session has an index of."""
    (tmp_path / "sf").symlink_to(SF)
    return str(tmp_path / "sf")


@pytest.mark.parametrize("name", ["person_matches", "location_matches", "index_stats"])
def test_what_reads_no_vectors_stores_and_moves_none(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    assert not [key for key in queries._STORED if key[1] == sf_dir]
    assert re.findall(r"ReadSchema: struct<[^>]*embedding", plan_of(out)) == [] and out.count() > 0


def test_keys_of_names_and_places_are_those_of_a_record(spark):
    rows = queries.keyed_photo_rows(spark, SF)
    columns = ["seq", "people_keys", "place_parts", "place_keys"]
    want = search.keyed(rows.drop(*columns[1:])).select(*columns)
    assert rows.select(*columns).exceptAll(want).count() == 0 and rows.count() == want.count() > 0


@pytest.mark.parametrize("name", ["sources_union", "sidecar_extraction"])
def test_sidecars_of_one_file_are_read_by_many_tasks(spark, name):
    parts = queries.QUERIES[name](spark, SF).select(F.spark_partition_id().alias("k")).distinct().count()
    assert parts >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_sidecar_is_read_once(spark):
    out = queries.QUERIES["sources_union"](spark, SF)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 3  # at most one for each part of the union


def test_an_index_of_lines_is_written_small(spark, sf_dir, monkeypatch):
    made = []
    monkeypatch.setattr(queries, "Workspace", lambda *a: made.append(Workspace(*a)) or made[-1])
    out = queries.QUERIES["index_lines"](spark, sf_dir)
    lines = Path(made[0].root.removeprefix("file:")) / "index"
    plain = sum(len(r.value) for r in spark.read.text(str(lines)).collect())
    assert out.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert sum(p.stat().st_size for p in lines.glob("part-*")) < 0.6 * plain
