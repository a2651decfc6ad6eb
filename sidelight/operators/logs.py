"""What the run logs tell: failures to retry, paths already tried, counts and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidelight.functions.text import has_cjk


def failed_paths(log: DataFrame) -> DataFrame:
    """``path``, ``seq``: each path that ended in an error, once, in the order of its first error."""
    return log.where(F.col("status") == "error").groupBy("path").agg(F.min("seq").alias("seq")).orderBy("seq")


def attempted_paths(log: DataFrame) -> DataFrame:
    return log.where(F.col("path").isNotNull()).select("path").distinct()


def glitched_paths(index: DataFrame) -> DataFrame:
    """``path``, ``seq`` of glitched records in the order of the index; a path may stand twice."""
    return index.where(has_cjk(F.col("description"), F.col("keywords"))).select("path", "seq").orderBy("seq")


def without(rows: DataFrame, done: DataFrame, on: str = "path") -> DataFrame:
    """An anti-join that keeps repeats of ``rows``, which EXCEPT would not."""
    return rows.join(done.select(on), on, "left_anti")


def to_repair(index: DataFrame, fix_log: DataFrame) -> DataFrame:
    return without(glitched_paths(index), attempted_paths(fix_log)).orderBy("seq")


def to_retry(log: DataFrame, tagged: DataFrame) -> DataFrame:
    """Failed paths whose sidecar is still untagged."""
    return without(failed_paths(log), tagged).orderBy("seq")


def run_stats(log: DataFrame, statuses, cost: Column | None = None) -> DataFrame:
    """``status``, ``n``, ``cost``; statuses that did not occur count 0, others than the known ones stand too."""
    spark = log.sparkSession
    known = spark.createDataFrame([(s,) for s in statuses], "status string")
    found = log.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("cost") if cost is None else cost, F.lit(0.0))).alias("cost"))
    return known.join(found, "status", "full").select("status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


def even_sample(rows: DataFrame, order: list, limit: int | None) -> DataFrame:
    """``limit`` rows at even steps in the given order; all, if that is no fewer.

    Places are ranks within ranges of the order plus what lies before each range, so no window holds all rows.
    """
    if limit is not None and limit <= 0:
        raise ValueError("limit must be above 0")
    n = rows.count()
    if limit is None or limit >= n:
        return rows.orderBy(*order)
    from sidelight.workspace import Workspace

    parts = max(1, min(n // 1_000_000 + 1, 10_000))
    ranged = Workspace(rows.sparkSession, "sample").table(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a range
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    wanted = sorted({int(i * (n / limit)) for i in range(limit)})
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("_part"))
    place = offset + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    picks = rows.sparkSession.createDataFrame([(w,) for w in wanted], "_place long")
    return ranged.withColumn("_place", place.cast("long")).join(F.broadcast(picks), "_place", "left_semi").orderBy(*order).drop("_part", "_place")
