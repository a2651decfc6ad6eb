"""Connected components of an edge table, without a graph library.

Alternating large-star and small-star rounds (Kiveris et al., 2014) on an edge
table; rounds grow with the logarithm of the graph's diameter. In a round each
node's smallest neighbour is an aggregation with map-side combine, written as a
table of one row a node; the edges then meet it in a join whose two sides are
shuffle reads, so that adaptive execution can split a hub with a large share of
the edges over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelight.workspace import Workspace


def _large_star(edges: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """The next edges, and the table that they are read from."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = ws.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
    moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct(), low


def _small_star(edges: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = ws.table(down.groupBy("u").agg(F.min("v").alias("m")), "low")
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct(), low


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``(u long, v long)`` to ``(node, component)``; the component is its smallest node.

    Self-loops, repeated edges and edges with a null end add nothing; only nodes
    that have an edge to another appear. An empty table gives an empty table.
    """
    now = ws.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(now)
    while before[0]:
        large, low = _large_star(now, ws)
        mid = ws.table(large, "mid")
        small, lower = _small_star(mid, ws)
        step = ws.table(small, "edges")
        ws.drop(now, low, mid, lower)
        now, after = step, _state(step)
        if after == before:
            break
        before = after
    leaves = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
