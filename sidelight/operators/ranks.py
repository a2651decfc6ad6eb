"""Positions in an order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sidelight.workspace import Workspace

RANGE = 50_000  # rows of a range, about; they are sorted in one task


def ranked(rows: DataFrame, order: list, place: str = "place") -> DataFrame:
    """``rows`` with their ``place`` from 1: ranks within ranges of the order, plus what lies before each range."""
    ws = Workspace(rows.sparkSession, "ranks")
    stored = ws.table(rows, "rows")  # counted, sampled for the ranges and dealt out: the plan behind it runs once
    parts = max(1, min(stored.count() // RANGE + 1, 10_000))
    ranged = ws.table(stored.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    ws.drop(stored)
    before, total = [], 0
    for r in sorted(ranged.groupBy("_part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_part"]):  # a row a range
        before.append((r["_part"], total))
        total += r["n"]
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in before for x in kv)), F.col("_part")) if before else F.lit(0)
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(place, (offset + within).cast("long")).drop("_part")
