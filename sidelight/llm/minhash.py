"""MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes its set of distinct word shingles (64-bit hashes), a
   128-bit digest of the set and 128 minima; equal sets collapse to their
   smallest id, so that a group of copies of any size costs one row from here.
2. 25 bands of 5 minima bucket the sets. At a similarity of 0.85 two sets share
   no bucket with probability 4.3e-7, at 0.80 with 4.9e-5.
3. A candidate pair is compared 16 minima at a time, and given up as soon as the
   posterior probability (uniform prior) that its similarity reaches the
   threshold falls below ``MISS``. Over all eight comparisons that loses 9.9e-6 of
   the pairs whose similarity is just 0.85, and 8.9e-6 of those at a threshold of
   0.80 with just that. Survivors are verified on their full sets.
4. Linked sets are joined to connected components.

Pairs inside a bucket are not all made. First every set meets one other, the most
popular of the buckets' leaders (of the largest buckets together, as the text
that others were copied from is); what is linked then is one component. After
that only buckets that still hold several components go on, and only pairs
across components. Buckets of up to ``SMALL`` sets make their few pairs in a
join. Larger ones are cut into blocks of about ``BLOCK`` sets, a row each with all its
sets' minima, and each two blocks meet as matrices; a pair is taken up in the first band
that it shares, so once. They meet twice. The first time a set gives back only the one
that it has most minima in common with, which joins most of what belongs together.
The second time the rest is compared to the end. Every set has one cell, whatever its
buckets, of about ``CELL`` sets of its largest bucket; blocks give back, not pairs, but
which sets have a survivor in another component, and which cells have any between them.
To those sets alone texts are joined, once each, and a cell's full sets are written in
rows of about ``SLICE_BYTES``. A cell, or two, finds its survivors again, verifies them,
and gives back no more links than connect its sets. No pair is skipped but those already
connected. So joins make a row for each set of a bucket and one for each two blocks or
cells that meet. A bucket of n sets that stay unlinked is still n * n comparisons, and
moves n * n / ``BLOCK`` sets' minima inside those rows; a set goes to the cells where it
has a survivor that no link has reached: a template that many unlike documents share
moves none.

Disk holds the minima, the band keys and the texts of bucketed sets once each, the
minima of a large bucket's sets once a bucket, and the full sets of those with such survivors.
All steps are joins and combining aggregations over written tables; nothing is
collected but row counts.

A very long text is one set like any other: its hashes and minima are made in pieces,
and only tasks that pack or verify its cell hold it. Of ties, the smallest id leads.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text of
fewer words than a shingle is one shingle; a null text or one without words is
empty, linked with nothing and its own component. Rows with one id are one
document, linked by whichever of their texts. A null id is linked with nothing:
component null, kept. An empty table gives an empty table. Extra columns, whatever
their names, are not read.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelight.llm.columns import read
from sidelight.llm.memory import SLICE_BYTES, release, sliced
from sidelight.operators.components import connected_components
from sidelight.workspace import Workspace

WIDTH, BANDS, ROWS, STEP = 5, 25, 5, 16
MINIMA = 128  # the bands use 125, the Bayesian test all
MISS = 1e-6
SMALL, BLOCK, CELL = 16, 1024, 256  # a block is BLOCK // CELL cells
_STRIPE = 128  # rows of a block whose pairs are compared at a time
_RNG = np.random.default_rng(20240501)
_MUL = _RNG.integers(0, 1 << 32, MINIMA, np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, MINIMA, np.uint32)
_WORD = _RNG.integers(0, 1 << 63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()  # of bytes, both are about ASCII alone
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    if n < width:
        return np.array([xxh3_64_intdigest(h.tobytes(), seed=n)], np.uint64)
    s = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        s += h[k : n - width + 1 + k] * _WORD[k % WIDTH]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x9FB21C651E98DF25)
    s ^= s >> np.uint64(28)
    return np.unique(s)


def minima(s: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):  # blocks that stay in the cache
        np.minimum(low, (_MUL[:, None] * x[None, at : at + 1024] + _ADD[:, None]).min(axis=1), out=low)
    return low


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """For each number of minima compared, the matches below which the posterior gives a pair up."""
    t = percent / 100

    def tail(m, n):  # P(similarity >= t | m of n match), prior uniform: a binomial sum
        return sum(comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))

    return tuple(next(m for m in range(n + 1) if tail(m, n) >= miss) for n in range(STEP, MINIMA + 1, STEP))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets; empty sets are similar to nothing."""
    if not len(a) or not len(b):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _fingerprints(batches):
    from xxhash import xxh3_128_digest

    for batch in sliced(batches, 1):
        size, d1, d2, sigs = [], [], [], []
        for text in batch.column(1):
            s = shingles(text.as_py())
            digest = np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64)
            size.append(len(s))
            d1.append(int(digest[0]))
            d2.append(int(digest[1]))
            sigs.append(minima(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sigs, pa.binary())],
            names=["doc", "n_shingles", "d1", "d2", "sig"],
        )


def _survivors_in(sigs: np.ndarray, comp: np.ndarray, n: int, alone: bool, least: tuple[int, ...], band: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (i, j) across components, of the first n rows with the rest or alone with each other, that share a band
    (first the given one) and pass the sequential test, with their matches."""
    met = [[np.empty(0, np.int64)] * 3]
    for at in range(0, n, _STRIPE):
        rows = np.arange(at, min(n, at + _STRIPE))
        i, j = (x.ravel() for x in np.meshgrid(rows, np.arange(at if alone else n, len(sigs)), indexing="ij"))
        open_ = (comp[i] != comp[j]) & (i < j)
        i, j = i[open_], j[open_]
        keep, matches = _likely(sigs, sigs, i, j, least)
        i, j = i[keep], j[keep]
        same = (sigs[i, : BANDS * ROWS] == sigs[j, : BANDS * ROWS]).reshape(len(i), BANDS, ROWS).all(axis=2)
        here = same.any(axis=1) & (band is None or same.argmax(axis=1) == band)
        met.append([i[here], j[here], matches[here].astype(np.int64)])
    i, j, matches = (np.concatenate(c) for c in zip(*met))
    return i, j, matches


def _each_meeting(work, schema: pa.Schema):
    """``work`` on the sets of each two blocks that meet, or of a block alone, and the survivors among them."""

    def run(batches, least):
        for batch in batches:
            for band, *blocks in zip(*(batch.column(c) for c in ("band", "left", "right"))):
                sides = [pa.Table.from_struct_array(x.values).sort_by("doc") for x in blocks if x.is_valid]
                table = pa.concat_tables(sides)
                pairs = _survivors_in(_minima_of(table.column("sig")), table.column("component").to_numpy(), len(sides[0]), len(sides) == 1, least, band.as_py())
                if len(pairs[0]):
                    yield from work(table, *pairs).cast(schema).to_batches()

    return run


def _nearest(table: pa.Table, i: np.ndarray, j: np.ndarray, matches: np.ndarray) -> pa.Table:
    """For each set with a survivor, the one it has most minima in common with, the smallest id of equals."""
    docs = table.column("doc").to_numpy()
    own, other, both = docs[np.append(i, j)], docs[np.append(j, i)], np.append(matches, matches)
    order = np.lexsort((other, -both, own))
    first = order[np.unique(own[order], return_index=True)[1]]
    return pa.table({"doc": own[first], "other": other[first], "matches": both[first]})


def _with_survivors(table: pa.Table, i: np.ndarray, j: np.ndarray, matches: np.ndarray) -> pa.Table:
    """A row for each cell that has survivors: the sets that do, and the cells, from itself on, where they have them."""
    docs, comp, home, cell = (table.column(c).to_numpy() for c in ("doc", "component", "home", "cell"))
    cells, of = np.unique(np.stack([home, cell.astype(np.int64)], axis=1), axis=0, return_inverse=True)
    of, at = of.ravel(), np.unique(np.append(i, j))
    met = np.unique(np.stack([np.minimum(of[i], of[j]), np.maximum(of[i], of[j])], axis=1), axis=0)
    rows = [
        {
            "home": int(cells[c, 0]), "cell": int(cells[c, 1]),
            "sets": [{"doc": int(docs[k]), "component": int(comp[k])} for k in at[of[at] == c]],
            "mates": [{"home": int(h), "cell": int(x)} for h, x in cells[met[met[:, 0] == c, 1]]],
        }
        for c in np.unique(met)
    ]
    return pa.Table.from_pylist(rows, _MET)


_NEAR = pa.schema([("doc", pa.int64()), ("other", pa.int64()), ("matches", pa.int64())])
_MET = pa.schema([
    ("home", pa.int64()), ("cell", pa.int32()), ("sets", pa.list_(pa.struct([("doc", pa.int64()), ("component", pa.int64())]))),
    ("mates", pa.list_(pa.struct([("home", pa.int64()), ("cell", pa.int32())]))),
])
_PACK = pa.schema([
    ("home", pa.int64()), ("cell", pa.int32()), ("part", pa.int32()), ("docs", pa.list_(pa.int64())), ("comps", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int64())), ("sigs", pa.binary()), ("sets", pa.binary()),
])


def _packed(table: pa.Table) -> pa.Table:
    """A cell's full sets and their minima, once, in rows of about ``SLICE_BYTES``; one for each text of an id."""
    if not table.num_rows:
        return _PACK.empty_table()
    home, cell = (table.column(c)[0].as_py() for c in ("home", "cell"))
    table = table.combine_chunks().group_by(["doc", "component", "text"]).aggregate([]).sort_by("doc")
    rows, sets, held = [], [], 0

    def end():
        rows.append({
            "home": home, "cell": cell, "part": len(rows), "docs": [d for d, _, _ in sets], "comps": [c for _, c, _ in sets],
            "sizes": [len(s) for _, _, s in sets], "sigs": b"".join(minima(s).tobytes() for _, _, s in sets), "sets": b"".join(s.tobytes() for _, _, s in sets),
        })

    for doc, comp, text in zip(*(table.column(c) for c in ("doc", "component", "text"))):
        s = shingles(text.as_py())
        if held and held + s.nbytes > SLICE_BYTES:
            end()
            sets, held = [], 0
        sets.append((doc.as_py(), comp.as_py(), s))
        held += s.nbytes
    end()
    return pa.Table.from_pylist(rows, _PACK)


def _cell_links(percent: int):
    """Verifies the survivors of a cell, or between two, by falling matches, on full sets; what it has connected meanwhile is passed over."""
    least = least_matches(percent)

    def links(sides):
        docs, comp, sizes = (np.concatenate([np.asarray(x[c].values) for x in sides]) for c in ("docs", "comps", "sizes"))
        sigs = np.concatenate([np.frombuffer(x["sigs"].as_buffer(), np.uint32) for x in sides]).reshape(-1, MINIMA)
        sets = [s for x in sides for s in np.split(np.frombuffer(x["sets"].as_buffer(), np.uint64), np.cumsum(np.asarray(x["sizes"].values))[:-1])]
        i, j, matches = _survivors_in(sigs, comp, len(sides[0]["docs"].values), len(sides) == 1, least)
        order, root = np.argsort(-matches, kind="stable"), {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in zip(i[order].tolist(), j[order].tolist()):
            a, b = find(comp[x]), find(comp[y])
            if a != b and similar(sets[x], sets[y], percent):
                root[max(a, b)] = min(a, b)
                yield min(docs[x], docs[y]), max(docs[x], docs[y])

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("left", "right"))):
                found = [*links([x for x in row if x.is_valid])]
                yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            release()

    return run


def _band_keys(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            rows = _minima_of(batch.column(1))[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
            keys = (rows * _BAND).sum(axis=2, dtype=np.uint64) + _BAND[:, 0]
            keys ^= keys >> np.uint64(32)
            keys *= np.uint64(0x9FB21C651E98DF25)
            keys ^= keys >> np.uint64(29)
            docs = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(band), pa.array(docs, pa.int64())], names=["key", "band", "doc"])
        del whole
        release()


def _minima_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), MINIMA)


def _likely(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (left[i], right[j]) the sequential test keeps to the end, and their matches."""
    open_, matches = np.arange(len(i)), np.zeros(len(i), np.int32)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (left[i[open_], part] == right[j[open_], part]).sum(axis=1, dtype=np.int32)
        good = matches >= need
        open_, matches = open_[good], matches[good]
        if not len(open_):
            break
    return open_, matches


def _survivors(percent: int):
    least = least_matches(percent)

    def run(batches):
        for batch in batches:
            left, right = (_minima_of(batch.column(i)) for i in (2, 3))
            each = np.arange(batch.num_rows)
            yield batch.select([0, 1]).take(pa.array(_likely(left, right, each, each, least)[0]))

    return run


def _verified(percent: int):
    def run(batches):
        last, left = None, None
        for batch in sliced(batches, 2):
            good = []
            for k, (a, ta, tb) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3))):
                ta = ta.as_py()
                if last != (a, ta):
                    last, left = (a, ta), shingles(ta)
                if similar(left, shingles(tb.as_py()), percent):
                    good.append(k)
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    return run


def _links_of_pairs(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those that are links: the sequential test, then the full sets."""
    likely = (
        pairs.join(sigs.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b")
        .join(sigs.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a")
        .select("a", "b", "sa", "sb").mapInArrow(_survivors(percent), "a long, b long").distinct()
    )
    return (
        likely.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
        .select("a", "b", "ta", "tb").mapInArrow(_verified(percent), "a long, b long").distinct()
    )


def _meetings(members: DataFrame, sigs: DataFrame, ws: Workspace) -> DataFrame:
    """Members of large buckets (key, band, n, doc, component) and what ``sigs`` has of them, in blocks of one row each, by two that meet."""
    many = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.select("key", "band", "doc", "component", many.alias("many"), F.pmod(F.xxhash64("doc"), many).cast("int").alias("block"))
    row = F.struct("doc", "component", *(c for c in sigs.columns if c != "doc"))
    blocks = ws.table(dealt.join(sigs, "doc").groupBy("key", "band", "many", "block").agg(F.collect_list(row).alias("sets")), "blocks")
    alone = blocks.select("band", F.col("sets").alias("left"), F.lit(None).cast(blocks.schema["sets"].dataType).alias("right"))
    first = blocks.where("block + 1 < many").select("key", "band", F.explode(F.expr("sequence(block + 1, many - 1)")).alias("block"), F.col("sets").alias("left"))
    return alone.union(first.join(blocks.select("key", "block", F.col("sets").alias("right")), ["key", "block"]).select("band", "left", "right"))


def _nearest_pairs(members: DataFrame, sigs: DataFrame, percent: int, ws: Workspace | None = None) -> DataFrame:
    """For each set with a survivor in its buckets, the pair (a, b) with its nearest one: as many as there are sets, at most."""
    least, work = least_matches(percent), _each_meeting(_nearest, _NEAR)
    near = _meetings(members, sigs, ws or Workspace(members.sparkSession, "minhash")).mapInArrow(lambda b: work(b, least), "doc long, other long, matches long")
    best = near.groupBy("doc").agg(F.max_by("other", F.struct("matches", -F.col("other"))).alias("other"))
    return best.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()


def _homed(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """``sigs`` of members, with the one cell of each: of its largest bucket, whose sets are dealt to cells of about ``CELL``."""
    homes = members.groupBy("doc").agg(F.max(F.struct("n", "key")).alias("home")).select("doc", F.col("home.key").alias("home"))
    cells = homes.groupBy("home").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    return sigs.join(homes.join(cells, "home").select("doc", "home", F.pmod(F.xxhash64("doc"), "cells").cast("int").alias("cell")), "doc")


def _met_cells(members: DataFrame, sigs: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    least, work = least_matches(percent), _each_meeting(_with_survivors, _MET)
    kinds = "home long, cell int, sets array<struct<doc:long,component:long>>, mates array<struct<home:long,cell:int>>"
    return ws.table(_meetings(members, _homed(members, sigs), ws).mapInArrow(lambda b: work(b, least), kinds), "met")


def _met_sets(members: DataFrame, sigs: DataFrame, percent: int, ws: Workspace | None = None) -> DataFrame:
    """Which sets still have survivors in other components, once each, with their cells (home, cell)."""
    return _sets_of(_met_cells(members, sigs, percent, ws or Workspace(members.sparkSession, "minhash")))


def _sets_of(met: DataFrame) -> DataFrame:
    once = met.groupBy("home", "cell").agg(F.array_distinct(F.flatten(F.collect_list("sets"))).alias("sets"))
    return once.select("home", "cell", F.inline("sets"))


def _links_of_blocks(ws: Workspace, members: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links across components inside large buckets, no more than connect the sets of a cell."""
    met = _met_cells(members, sigs, percent, ws)
    cell = "home", "cell"
    packs = "home long, cell int, part int, docs array<long>, comps array<long>, sizes array<long>, sigs binary, sets binary"
    packed = ws.table(_sets_of(met).join(texts, "doc").groupBy(*cell).applyInArrow(_packed, packs), "packs")
    pack = packed.select(*cell, "part", F.struct("docs", "comps", "sizes", "sigs", "sets").alias("pack"))
    mates = ws.table(met.select(*cell, F.explode("mates").alias("mate")).distinct(), "mates")
    first = mates.join(pack.withColumnRenamed("pack", "left"), [*cell]).select(
        F.col("mate.home").alias("home"), F.col("mate.cell").alias("cell"), "left", F.when((F.col("mate.home") == F.col("home")) & (F.col("mate.cell") == F.col("cell")), F.col("part")).alias("own"),
    )
    both = first.join(pack.withColumnRenamed("pack", "right"), [*cell]).where("own is null or own <= part")
    return both.select("left", F.when(F.col("own").isNull() | (F.col("own") < F.col("part")), F.col("right")).alias("right")).mapInArrow(_cell_links(percent), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept``: a row for each row of ``df``."""
    ws = Workspace(df.sparkSession, "minhash")
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    prints = ws.table(docs.mapInArrow(_fingerprints, "doc long, n_shingles long, d1 long, d2 long, sig binary"), "prints")
    sets = prints.where("doc is not null and n_shingles > 0")
    copies = ws.table(sets.groupBy("d1", "d2").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    spare = sets.select("d1", "d2", "doc").join(copies, ["d1", "d2"]).where("doc <> first").select("doc", "d1", "d2")
    firsts = sets.join(spare, ["doc", "d1", "d2"], "left_anti").select("doc", "sig")

    bands = ws.table(firsts.mapInArrow(_band_keys, "key long, band int, doc long"), "bands")
    shared = ws.table(bands.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n"), "shared")
    buckets = ws.table(bands.join(shared, "key").distinct(), "buckets")
    ws.drop(bands, shared)
    popular = ws.table(buckets.groupBy("doc").agg(F.sum("n").alias("fame")), "bucketed")
    sigs = ws.table(firsts.join(popular, "doc", "left_semi"), "sigs")
    texts = ws.table(docs.join(popular, "doc", "left_semi"), "texts")

    ranked = buckets.join(popular, "doc").select("key", "doc", F.struct(F.col("fame"), (-F.col("doc")).alias("minus")).alias("rank"))
    leaders = ws.table(ranked.groupBy("key").agg(F.max("rank").alias("lead")), "leaders")
    hubs = buckets.select("key", "doc").join(leaders, "key").groupBy("doc").agg(F.max("lead").alias("lead")).select("doc", (-F.col("lead.minus")).alias("hub"))
    pairs = ws.table(hubs.where("doc <> hub").select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct(), "pairs")
    # an id whose rows differ in text is one document, and joins what each of them is a copy of
    digest = F.struct("d1", "d2")
    several = sets.groupBy("doc").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select("doc")
    own = sets.join(several, "doc", "left_semi").join(copies, ["d1", "d2"]).where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b"))
    links = ws.table(_links_of_pairs(pairs, sigs, texts, percent).union(own), "links")

    def components(found):
        return ws.table(connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v")), ws), "labels")

    def open_buckets(labels):
        """Buckets that hold several components, with their members'."""
        placed = buckets.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        return ws.table(placed.join(ws.table(mixed, "mixed"), "key", "left_semi"), "open")

    labels = components(links)
    open_ = open_buckets(labels)
    large = F.col("n") > SMALL
    nearest = ws.table(_nearest_pairs(open_.where(large), sigs, percent, ws).join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not nearest.isEmpty():
        links, first_links = ws.table(links.union(_links_of_pairs(nearest, sigs, texts, percent)), "links"), links
        labels = components(links)
        ws.drop(open_, first_links)
        open_ = open_buckets(labels)
    few = open_.where(~large)
    other = few.select("key", F.col("doc").alias("a"), F.col("component").alias("other"))
    again = few.select("key", F.col("doc").alias("b"), "component").join(other, "key").where("a < b and component <> other").select("a", "b").distinct()
    again = ws.table(again.join(pairs.union(nearest), ["a", "b"], "left_anti"), "pairs")
    more = ws.table(_links_of_pairs(again, sigs, texts, percent).union(_links_of_blocks(ws, open_.where(large), sigs, texts, percent)), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    ws.drop(buckets, popular, sigs, texts, leaders, pairs, nearest, links, open_, again, more)

    return (
        prints.select("doc", "n_shingles", "d1", "d2").join(copies, ["d1", "d2"], "left")
        .withColumn("first", F.when(F.col("doc").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("first", "doc")).otherwise(F.col("doc")))
        .join(labels.withColumnRenamed("node", "first"), "first", "left")
        .select(F.col("doc").alias("doc_id"), "n_shingles", F.coalesce("component", "first").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``df`` without the documents that are not the smallest id of their component."""
    gone = near_duplicates(df, id_col, text_col, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    gone = Workspace(df.sparkSession, "gone").table(gone, "ids")
    return df.join(gone, df[id_col] == gone["_gone"], "left_anti")


def op1_minhash(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85)


OP1_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), grams as materialized (
  select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as g
  from words
), sizes as materialized (
  select doc_id, count(*) as n from grams group by doc_id
), links as materialized (
  select x.doc_id as a, y.doc_id as b
  from grams x join grams y on x.g = y.g and x.doc_id < y.doc_id
  join sizes sx on sx.doc_id = x.doc_id join sizes sy on sy.doc_id = y.doc_id
  group by x.doc_id, y.doc_id, sx.n, sy.n
  having 100 * count(*) >= 85 * (sx.n + sy.n - count(*))
), edges as materialized (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, e.b from reach r join edges e on r.b = e.a
), component as (
  select a as doc_id, min(b) as component_id from reach group by a
)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d join component c using (doc_id) left join sizes s using (doc_id)
"""
