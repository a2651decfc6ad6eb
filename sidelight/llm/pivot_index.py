"""Exact top-k by inner product with a pivot-distance index.

Vectors are quantised to integers, keyed by their nearest pivot and their
distance to it, and fall into annuli (cell, ring). For a query q, and an annulus
of pivot p with distances from a to b and norms up to m, the triangle inequality
gives |q - x| >= low = max(0, |q - p| - b, a - |q - p|), and so

    q . x  <=  min( (|q|^2 + m^2 - low^2) / 2,  q . p + |q| b ).

A query first searches the annulus of its highest bound that holds enough
vectors; its k-th best score there is what any other annulus must be able to
reach. Annuli are then taken in the order of their bounds, and all from the first
that falls below are left out. The result is exact; the order of ties is by id.

Pivots are fitted on at most ``SAMPLE`` vectors; every vector is indexed. Their
number grows with the root of the number of vectors, from ``PIVOTS`` to
``MOST_PIVOTS``, and there are ``RINGS`` annuli around each, whose summary is all
that is collected. An annulus, which may hold any share of the vectors (a third of
them may be one vector), is cut into blocks of about ``BLOCK_BYTES`` by a hash of
the id, the queries that visit it into blocks too, and each two blocks meet as
matrices under a key of their own, so that the join has as many keys as there are
pairs of blocks. A task keeps the best k of each query it meets, so that little is
shuffled for the final k.

Defined results: a null vector, or one with a null or non-finite component, takes
no part, nor does a row with a null id. Vectors of unequal length are compared as
if the shorter went on with zeros. Rows with one id are one candidate if their
vectors are equal, else several; a query's own id is no candidate. Scores are
exact while below 2 ** 53. Vectors of any length take part, in smaller blocks. An
empty table gives an empty table. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sidelight.llm.columns import read
from sidelight.workspace import Workspace

PIVOTS, MOST_PIVOTS, RINGS, SAMPLE, SCALE = 16, 256, 4, 4096, 256
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 4096


def pivots_for(n: int) -> int:
    """16 for up to 16,384 vectors, then the root of their number by 8."""
    return min(MOST_PIVOTS, max(PIVOTS, int(n**0.5 / 8)))


def block_rows(width: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))


def quantised(vec):
    """floor(SCALE * x) of each component, null where the vector takes no part."""
    wide = vec.cast("array<double>")
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * SCALE)))


def _matrix(blobs: list[bytes], width: int | None = None) -> np.ndarray:
    """Rows of float64 components, padded with zeros to the longest."""
    width = max([len(b) // 8 for b in blobs], default=0) if width is None else width
    if all(len(b) == 8 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), width)
    return np.array([np.pad(np.frombuffer(b, np.float64)[:width], (0, max(0, width - len(b) // 8))) for b in blobs]).reshape(len(blobs), width)


def _wider(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def fit_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Far-apart vectors of the sample, moved to the means of what is nearest to them."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [sample.mean(axis=0)]
    away = np.full(len(sample), np.inf)
    while len(chosen) < min(pivots, len(sample)):
        away = np.minimum(away, ((sample - chosen[-1]) ** 2).sum(axis=1))
        chosen.append(sample[int(np.argmax(away))])
    c = np.array(chosen)
    for _ in range(5):
        own = np.argmin(_squares(sample, c), axis=1)
        for j in np.unique(own):
            c[j] = sample[own == j].mean(axis=0)
    return c


def _squares(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * x @ p.T)


class PivotIndex:
    """Pivots and ring borders, and once all vectors are keyed, the annuli's summary."""

    def __init__(self, sample: np.ndarray, pivots: int = PIVOTS) -> None:
        self.pivots = fit_pivots(sample, pivots)
        own, dist = self.nearest(sample) if len(sample) else (np.empty(0, int), np.empty(0))
        steps = np.linspace(0, 1, RINGS + 1)[1:-1]
        self.borders = np.array([np.quantile(dist[own == j], steps) if (own == j).any() else np.zeros(len(steps)) for j in range(len(self.pivots))])
        self.annuli: list[tuple] = []

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = _wider(x, self.pivots.shape[1])
        d = _squares(x, _wider(self.pivots, x.shape[1]))
        own = np.argmin(d, axis=1)
        return own, np.sqrt(d[np.arange(len(x)), own])

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, dist = self.nearest(x)
        ring = (dist[:, None] > self.borders[own]).sum(axis=1)
        return own * RINGS + ring, dist

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Queries x annuli: what no score in the annulus exceeds, with a margin for rounding."""
        q = _wider(q, self.pivots.shape[1])
        p = _wider(self.pivots, q.shape[1])
        unit, _, near, far, norm = (np.array(c, float) for c in zip(*self.annuli))
        cell = unit.astype(int) // RINGS
        to = np.sqrt(_squares(q, p))[:, cell]
        q2 = (q * q).sum(axis=1)[:, None]
        low = np.maximum(0.0, np.maximum(to - far, near - to))
        best = np.minimum((q2 + norm**2 - low**2) / 2, (q @ p.T)[:, cell] + np.sqrt(q2) * far)
        return best + 1e-6 * (1 + np.abs(best))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _meet(k: int):
    """Joined blocks in, each query's best k of the task out."""

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            rows = [(q, int(v), int(s)) for q, (ss, vs) in best.items() for s, v in zip(ss, vs)]
            cols = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for q_ids, q_vecs, ids, vecs in zip(*(batch.column(i) for i in range(4))):
                q_ids, ids = np.array(q_ids.as_py(), np.int64), np.array(ids.as_py(), np.int64)
                q, x = _matrix(q_vecs.as_py()), _matrix(vecs.as_py())
                width = max(q.shape[1], x.shape[1])
                scores = _wider(q, width) @ _wider(x, width).T
                if len(ids) > 4 * k:  # all that reach the k+1-th score; one more, as the query itself may be there
                    floor = np.partition(scores, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]
                else:
                    floor = np.full(len(q_ids), -np.inf)
                for i, qid in enumerate(q_ids.tolist()):
                    take = np.flatnonzero((scores[i] >= floor[i]) & (ids != qid))
                    s, v = scores[i, take], ids[take]
                    if qid in best:
                        s, v = np.concatenate((best[qid][0], s)), np.concatenate((best[qid][1], v))
                    best[qid] = _top(s, v, k)
                if len(best) > 100_000:
                    yield out()
                    best.clear()
        yield out()

    return run


def top_k(df: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``; ``queries`` is a condition on ``id_col``'s rows."""
    spark = df.sparkSession
    ws = Workspace(spark, "pivots")
    rows = df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col)).alias("v"), queries.alias("asks")).where("id is not null and v is not null")
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    n = rows.count()
    some = rows.where(draw < int((1 << 30) * min(1.0, 1.2 * SAMPLE / max(n, 1)))).orderBy(draw, "id").limit(SAMPLE).select("v").collect()
    index = PivotIndex(_matrix([np.array(r["v"], np.float64).tobytes() for r in some]), pivots_for(n))
    widest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    block = block_rows(widest)

    def keyed(batches):
        for batch in batches:
            blobs = [np.array(v, np.float64).tobytes() for v in batch.column(1).to_pylist()]
            x = _matrix(blobs)
            unit, dist = index.key(x) if len(blobs) else (np.empty(0, np.int64), np.empty(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(blobs, pa.binary()), pa.array(unit, pa.int32()), pa.array(dist, pa.float64()), pa.array(np.sqrt((x * x).sum(axis=1)), pa.float64())],
                names=["id", "asks", "v", "unit", "dist", "norm"],
            )

    table = ws.table(rows.distinct().mapInArrow(keyed, "id long, asks boolean, v binary, unit int, dist double, norm double"), "keyed")
    summary = table.groupBy("unit").agg(F.count("*").alias("n"), F.min("dist"), F.max("dist"), F.max("norm")).orderBy("unit").collect()
    index.annuli = [tuple(r) for r in summary]
    units = [a[0] for a in index.annuli]
    # a row an annulus: in how many blocks it is cut; MOST_PIVOTS x RINGS rows at most
    rows_of = F.array(*(F.struct(F.lit(r["unit"]).alias("unit"), F.lit(-(-r["n"] // block)).cast("long").alias("many")) for r in summary)).cast("array<struct<unit:int,many:long>>")
    cut = F.broadcast(df.sparkSession.range(1).select(F.inline(rows_of)))

    def packed(members: DataFrame, of: str, seed: int) -> DataFrame:
        """Rows of ``unit``, ``id``, ``v`` and the number of blocks ``of`` their annulus, as a row a block."""
        by_hash = F.pmod(F.xxhash64("id", F.lit(seed)), F.col(of)).alias("block")
        found = members.select("unit", by_hash, "id", "v").groupBy("unit", "block").agg(F.collect_list(F.struct("id", "v")).alias("r"))
        return found.select("unit", "block", F.col("r.id").alias("ids"), F.col("r.v").alias("vecs"))

    blocks = ws.table(packed(table.join(cut, "unit"), "many", 1), "blocks")

    def visits(bar: bool):
        """Which annuli a query visits: without a bar yet the one of the highest bound, then, from the
        sorted rest, all before the first whose bound is below the bar."""

        def run(batches):
            size = np.array([a[1] for a in index.annuli])
            for batch in batches:
                m = batch.num_rows
                to_q, to_u = np.empty(0, np.int64), np.empty(0, np.int64)
                if m and units:
                    bound = index.bounds(_matrix(batch.column(1).to_pylist()))
                    start = np.argmax(np.where(size[None] > k, bound, -np.inf), axis=1)
                    if not bar:
                        to_q, to_u = np.arange(m), start
                    else:
                        order = np.argsort(-bound, axis=1, kind="stable")
                        need = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                        ahead = np.take_along_axis(bound, order, axis=1) >= np.where(np.isnan(need), -np.inf, need)[:, None]
                        to_q, at = np.nonzero(np.logical_and.accumulate(ahead, axis=1))
                        to_u = order[to_q, at]
                        new = to_u != start[to_q]
                        to_q, to_u = to_q[new], to_u[new]
                picked = batch.select([0, 1]).take(pa.array(to_q, pa.int64()))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.array(units, np.int32)[to_u] if units else [], pa.int32())], names=["id", "v", "unit"])

        return run

    def searched(visiting: DataFrame, expected: int) -> DataFrame:
        asked = F.lit(max(1, -(-expected // block)))
        # each block of queries goes to every block of its annulus, and each of those to every block of queries
        theirs = packed(visiting.withColumn("asked", asked), "asked", 2).join(cut, "unit").select(
            "unit", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("block"),
        )
        own = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), asked.cast("long") - 1)).alias("q_block"))
        return theirs.join(own, ["unit", "block", "q_block"]).select("q_ids", "q_vecs", "ids", "vecs").mapInArrow(_meet(k), "query_id long, vec_id long, score long")

    asking = ws.table(table.where("asks").select("id", "v"), "queries")
    n_queries = asking.count()
    first = ws.table(searched(asking.mapInArrow(visits(False), "id long, v binary, unit int"), n_queries), "first")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    bars = first.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bar"))
    rest = searched(asking.join(bars, "id", "left").select("id", "v", "bar").mapInArrow(visits(True), "id long, v binary, unit int"), n_queries)
    ranked = first.union(rest).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_pivot_index(spark, sf_dir):
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""
