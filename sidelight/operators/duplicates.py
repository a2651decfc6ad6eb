"""Near-duplicates: clusters of records of one folder whose embeddings are alike.

Vectors of a folder are compared as matrices, in blocks of about ``BLOCK`` that meet
pairwise, so that a folder of any size is spread over tasks and no task holds more
than two blocks. Pairs below the threshold are never rows. How many pairs were
compared follows from the folders' sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sidelight.functions.vectors import dot, unit
from sidelight.operators.components import connected_components
from sidelight.workspace import Workspace

THRESHOLD, MIN_CLUSTER, BLOCK = 0.93, 2, 2048
SMALL = 64  # records of a folder that are joined as rows


def folder_of(path):
    """The parent directory; ``.`` for a bare name, ``/`` for one right under the root."""
    return (
        F.when(~F.contains(path, F.lit("/")), F.lit(".")).when(F.regexp_like(path, F.lit("^/[^/]*$")), F.lit("/"))
        .otherwise(F.regexp_extract(path, "^(.*)/[^/]*$", 1))
    )


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions, and vectors at length 1 as rows."""
    table = table.combine_chunks()
    seq = table.column("seq").to_numpy()
    flat = np.asarray(table.column("vector").combine_chunks().flatten(), np.float64)
    x = flat.reshape(len(seq), -1) if len(seq) else np.empty((0, 0))
    norms = np.sqrt((x * x).sum(axis=1))
    return seq, x / np.where(norms == 0, 1e-9, norms)[:, None]


def _alike(one: tuple, other: tuple | None, threshold: float) -> pa.Table:
    """Pairs of a block with another, or within one; a score that is no number counts as the largest, as in SQL."""
    seq, x = one
    others, y = one if other is None else other
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
    for at in range(0, len(seq) if len(others) else 0, 256):
        scores = x[at : at + 256] @ y.T
        a, b = np.nonzero(~(scores < threshold))
        u, v = seq[at + a], others[b]
        keep = u < v if other is None else u != v
        for c, values in zip(out, (np.minimum(u, v)[keep], np.maximum(u, v)[keep], scores[a, b][keep])):
            c.append(values)
    return pa.table({k: np.concatenate(c) for k, c in zip(("a", "b", "score"), out)})


def _meet(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        first = _matrix(table.filter(pc.equal(table.column("side"), 0)))
        return _alike(first, None if within else _matrix(table.filter(pc.equal(table.column("side"), 1))), threshold)

    return run


def _meet_joined(threshold: float):
    def run(key: tuple, one: pa.Table, other: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key[-2:])
        return _alike(_matrix(one), None if i == j else _matrix(other), threshold)

    return run


def similar_pairs(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a``, ``b`` (positions, a < b), ``score``; ``records``: seq, folder, vector. Vectors have one width."""
    sizes = records.groupBy("folder").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("many"))
    # a table of its own, so that the join reads both sides from shuffles and a huge folder can be split
    sizes = Workspace(records.sparkSession, "folders").table(sizes, "sizes")
    mine = F.pmod(F.xxhash64("seq"), F.col("many")).cast("int")
    dealt = records.join(sizes, "folder").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = dealt.select(
        "folder", "seq", F.col("vector").cast("array<double>").alias("vector"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
    )
    return dealt.groupBy("folder", "i", "j").applyInArrow(_meet(threshold), "a long, b long, score double")


def similar_pairs_joined(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same pairs as an equi-join, which passes over vectors that are missing, hold a null or differ in width.

    Records of folders of at most ``SMALL`` are joined as rows, so that one makes no more than as many. A larger
    folder's blocks are joined, each two of them once.
    """
    whole = records.select("folder", "seq", "vector").where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    whole = whole.withColumn("width", F.size("vector"))
    sizes = Workspace(records.sparkSession, "folders").table(whole.groupBy("folder", "width").agg(F.count("*").alias("n")), "sizes")
    sized = whole.join(sizes, ["folder", "width"])
    units = sized.where(F.col("n") <= SMALL).select("folder", "width", "seq", unit(F.col("vector")).alias("u"))
    a, b = (units.select("folder", "width", F.col("seq").alias(k), F.col("u").alias(f"u{k}")) for k in ("a", "b"))
    rows = a.join(b, ["folder", "width"]).where("a < b").select("a", "b", dot(F.col("ua"), F.col("ub")).alias("score")).where(F.col("score") >= threshold)
    many = F.ceil(F.col("n") / BLOCK).cast("int")
    large = sized.where(F.col("n") > SMALL).select("folder", "width", "seq", "vector", (many - 1).alias("last"), F.pmod(F.xxhash64("seq"), many).cast("int").alias("mine"))
    key = ["folder", "width", "i", "j"]
    one = large.select("folder", "width", F.col("mine").alias("i"), F.explode(F.sequence("mine", "last")).alias("j"), "seq", "vector")
    # a block that meets itself comes from one side alone
    other = large.where("mine > 0").select("folder", "width", F.explode(F.sequence(F.lit(0), F.col("mine") - 1)).alias("i"), F.col("mine").alias("j"), "seq", "vector")
    other = other.toDF(*other.columns)
    met = one.groupBy(*key).cogroup(other.groupBy(*key)).applyInArrow(_meet_joined(threshold), "a long, b long, score double")
    return rows.unionByName(met)


def compared_pairs(records: DataFrame) -> DataFrame:
    """How many pairs the folders hold, from their sizes."""
    n = records.groupBy("folder").agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("compared_pairs"))


def clusters(records: DataFrame, threshold: float = THRESHOLD, min_cluster: int = MIN_CLUSTER) -> DataFrame:
    """``cluster`` (smallest position), ``size``, ``avg_similarity`` and ``photos``, largest and most alike first.

    ``records``: seq, path, description, folder, vector.
    """
    ws = Workspace(records.sparkSession, "duplicates")
    edges = ws.table(similar_pairs(records.select("seq", "folder", "vector"), threshold), "edges")
    labels = ws.table(connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), ws), "labels")
    alike = edges.join(labels, edges["a"] == labels["node"]).groupBy("component").agg(F.round(F.avg("score"), 4).alias("avg_similarity"))
    named = records.select("seq", "path", "description").join(labels.withColumnRenamed("node", "seq"), "seq", "left" if min_cluster <= 1 else "inner")
    grouped = named.groupBy(F.coalesce("component", "seq").alias("cluster")).agg(
        F.count("*").cast("int").alias("size"), F.array_sort(F.collect_list(F.struct("path", "description"))).alias("photos"),
    )
    out = grouped.where(F.col("size") >= min_cluster).join(alike.withColumnRenamed("component", "cluster"), "cluster", "left")
    return out.select("cluster", "size", "avg_similarity", "photos").orderBy(F.col("size").desc(), F.coalesce("avg_similarity", F.lit(0.0)).desc(), "cluster")


def totals(records: DataFrame, found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of what is said of the whole: ``threshold``, ``total_photos``, ``compared_pairs``, ``n_clusters``, and
    ``clustered_photos``, how many records ``found`` (``clusters``) holds."""
    held = found.agg(F.count("*").alias("n_clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("clustered_photos"))
    parts = [d.withColumn("_one", F.lit(1)) for d in (records.agg(F.count("*").alias("total_photos")), compared_pairs(records), held)]
    joined = parts[0].join(parts[1], "_one").join(parts[2], "_one")
    return joined.select(F.lit(float(threshold)).alias("threshold"), "total_photos", "compared_pairs", "n_clusters", "clustered_photos")


def report_lines(records: DataFrame, threshold: float = THRESHOLD, min_cluster: int = MIN_CLUSTER) -> DataFrame:
    """The report as one JSON document, as ``line``s in the order of ``place``: a head, a cluster a line, an end.

    No row holds all clusters. They are ranked in one task, by size, likeness and first position.
    """
    found = Workspace(records.sparkSession, "report").table(clusters(records, threshold, min_cluster), "clusters")
    head = totals(records, found, threshold).select(
        F.lit(0).cast("long").alias("place"),
        F.format_string('{"threshold": %s, "total_photos": %d, "compared_pairs": %d, "clusters": [', F.col("threshold").cast("string"), "total_photos", "compared_pairs").alias("line"),
    )
    order = Window.orderBy(F.col("size").desc(), F.coalesce("avg_similarity", F.lit(0.0)).desc(), "cluster")
    ranked = found.select(F.row_number().over(order).cast("long").alias("place"), F.to_json(F.struct("size", "avg_similarity", "photos"), {"ignoreNullFields": "false"}).alias("json"))
    body = ranked.select("place", F.concat(F.when(F.col("place") > 1, F.lit(",")).otherwise(F.lit("")), F.col("json")).alias("line"))
    end = records.sparkSession.createDataFrame([((1 << 62), "]}")], "place long, line string")
    return head.unionByName(body).unionByName(end)
