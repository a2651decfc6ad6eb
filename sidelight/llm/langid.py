"""Language ID by nearest centroids of TF-IDF n-gram vectors.

A text's letters (lower-cased, everything else a single space) are counted as
hashed uni-, bi- and trigrams of characters; the vector is log-scaled, weighted
by inverse document frequency and normalised. Each language has several
centroids, from spherical k-means over its learning rows; the prediction is the
language of the centroid with the largest cosine, and that cosine the score.

A document is rejected by distance: if its cosine is below ``SLACK`` times that of
its length class (a power of two of letters), which is the ``LOW`` quantile of the
cosines that all labelled rows of the class have with their own language, learning
rows or not. Classes with less than ``POOL`` rows are one with the next longer ones,
and what is left at the long end is one with those before; so few odd rows set no
threshold, and at most ``LOW`` of a pool is rejected. Under ``1 / LOW`` labelled rows
the quantile is the lowest. A length class longer than all labelled rows takes the
threshold of the longest, and one shorter than all rejects none. A centroid that
less than ``SMALL`` of its language's learning rows, or a single one, are nearest
to is left out: it would take odd rows as the rule. A text without a letter is
always rejected.

Learning takes at most ``TRAIN_ROWS`` rows of each language, the first by a hash of
id and text; rows equal in both are learned from once. Language counts, thresholds
and everything at prediction cover all rows and whole texts. One pass draws the rows
of all languages and counts their grams, which are written as a sparse table; how
many rows hold a gram is an aggregation over it, and each language is clustered in a
task of its own, on a dense array of ``TRAIN_ROWS`` x ``BUCKETS`` numbers at most. The
driver sees neither texts nor counts of single rows, but the model: a bounded array
(``BUCKETS`` x ``CENTROIDS`` numbers a language) that the tasks carry. Labels are
languages; more than ``MAX_LANGUAGES`` of them are refused with an error.

Defined results: a null text, or one without letters, gives ``und`` with score 0,
rejected. Without learning rows every text does. Rows with a null id are never
learned from. Ties between languages go to the first by name. Repeated rows and
extra columns pass through; columns named like the added ones are replaced. A very
long text is counted in pieces, as a whole. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidelight.llm.columns import read
from sidelight.llm.memory import sliced
from sidelight.workspace import Workspace

BUCKETS, CENTROIDS, TRAIN_ROWS, MAX_LANGUAGES = 1 << 13, 4, 1500, 1000
SLACK, LOW, POOL, SMALL = 0.6, 0.01, 200, 0.02
_BINS = 10_000  # of cosines, counted to find quantiles
UND = "und"
_PIECE = 1 << 18  # characters counted at a time, so that long texts stay small


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """A code point's own number if it is a letter, else a space's."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def ngram_counts(text: str | None) -> tuple[np.ndarray, int]:
    """Hashed counts over the whole text, and its number of letters."""
    out, letters, tail = np.zeros(BUCKETS, np.int64), 0, np.array([32], np.uint32)
    text = (text or "").lower()
    for at in range(0, len(text), _PIECE):
        codes = _letters()[np.frombuffer(text[at : at + _PIECE].encode("utf-32-le", "replace"), np.uint32)]
        letters += int(np.count_nonzero(codes != 32))
        c = np.concatenate((tail, codes, np.array([32], np.uint32) if at + _PIECE >= len(text) else codes[:0]))
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
        # two characters carry over, and count no gram again that lies within them
        old = len(tail) if at else 0
        a = c * np.uint32(0x9E3779B1)
        two = (a[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + a[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE35) + a[2:] if len(c) > 2 else a[:0]
        for grams, size in ((a, 1), (two, 2), (three, 3)):
            g = grams[max(0, old - size + 1) if at else 0 :]
            g = (g ^ (g >> np.uint32(13))) * np.uint32(0x27D4EB2F)
            out += np.bincount(g >> np.uint32(32 - 13), minlength=BUCKETS)
        tail = c[-2:]
    return out, letters


def _length_class(letters: int) -> int:
    return min(letters, 1 << 30).bit_length()


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    vectors: np.ndarray
    idf: np.ndarray
    low: list[float]  # the quantile by length class, 0 for none

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts).astype(np.float32) * self.idf
        n = float(np.sqrt(v @ v))
        return v / n if n else v

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts, letters = ngram_counts(text)
        if not letters or not self.languages:
            return UND, 0.0, True
        cosines = self.vectors @ self.vector(counts)
        best = int(np.argmax(cosines))
        score = min(1.0, max(0.0, float(cosines[best])))
        return self.languages[best], score, score < SLACK * self.low[_length_class(letters)]


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the rows farthest from those chosen before."""
    k = min(k, len(x))
    chosen = [x.mean(axis=0) / max(1e-9, np.linalg.norm(x.mean(axis=0)))]
    while len(chosen) < k:
        chosen.append(x[int(np.argmin(np.max(x @ np.array(chosen).T, axis=1)))])
    c = np.array(chosen)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(k):
            if (mine := own == j).any():
                m = x[mine].sum(axis=0)
                c[j] = m / max(1e-9, np.linalg.norm(m))
    held = np.bincount(np.argmax(x @ c.T, axis=1), minlength=k)
    large = held >= min(held.max(), max(2, SMALL * len(x)))
    return c[large].astype(np.float32)


def fit_centroids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids:
    """Learns from the rows of ``df`` with id, text and language; at most ``TRAIN_ROWS`` of each language."""
    ws = Workspace(df.sparkSession, "langid")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} holds more than {MAX_LANGUAGES} values")
    sample = ws.table(_sample(rows, counts), "sample")
    model = _fit(sample)
    ws.drop(sample)
    if model.languages:
        met = rows.select("lang", "text").mapInArrow(lambda batches: _own_cosines(model, batches), "class int, bin int, n long")
        model.low = _low(met.groupBy("class", "bin").agg(F.sum("n").alias("n")).collect())
    return model


def _sample(rows: DataFrame, counts: dict[str, int]) -> DataFrame:
    """``lang``, ``draw`` and the sparse counts of the rows to learn from, of all languages in one pass."""
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 62))
    # about as many pass as are wanted, so that few texts are counted; small languages pass as a whole
    share = [F.lit(x) for lang, n in counts.items() for x in (lang, int((1 << 62) * min(1.0, 1.2 * TRAIN_ROWS / n)))]
    bound = F.element_at(F.create_map(*share), F.col("lang")) if share else F.lit(0)
    drawn = rows.select(F.col("lang").cast("string").alias("lang"), "text", draw.alias("draw")).where(F.col("draw") < bound)
    told = drawn.select("lang", "draw", "text").mapInArrow(_sparse_counts, "lang string, draw long, at binary, counts binary")
    once = told.groupBy("lang", "draw").agg(F.first("at").alias("at"), F.first("counts").alias("counts"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    return once.withColumn("place", place).where(F.col("place") <= TRAIN_ROWS).drop("place")


def _sparse_counts(batches):
    """The grams of each text with a letter, as bucket numbers (16 bits) and counts (32)."""
    for batch in sliced(batches, 2):
        out: list = [[], [], [], []]
        for lang, draw, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            counts, letters = ngram_counts(text.as_py())
            if letters:
                at = np.flatnonzero(counts)
                for c, x in zip(out, (lang, draw, at.astype(np.uint16).tobytes(), counts[at].astype(np.uint32).tobytes())):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "draw", "at", "counts"])


def _holders(batches):
    """How many of the rows hold each bucket; under bucket -1, how many rows there are."""
    seen = np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        for at in batch.column(0):
            seen[np.frombuffer(at.as_py(), np.uint16)] += 1
        seen[-1] += batch.num_rows
    bucket = np.append(np.arange(BUCKETS), -1)
    yield pa.RecordBatch.from_arrays([pa.array(bucket[seen > 0], pa.int32()), pa.array(seen[seen > 0])], names=["bucket", "n"])


def _fit(sample: DataFrame) -> Centroids:
    """Inverse document frequencies over all rows of the sample, then the centroids of each language in its own task."""
    held = {r["bucket"]: r["n"] for r in sample.select("at").mapInArrow(_holders, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    seen = np.zeros(BUCKETS)
    for bucket, n in held.items():
        if bucket >= 0:
            seen[bucket] = n
    idf = np.log((1 + held.get(-1, 0)) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    model = Centroids([], np.zeros((0, BUCKETS), np.float32), idf, [0.0] * 32)

    def clustered(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("at", "ascending")])
        x = np.zeros((table.num_rows, BUCKETS), np.float32)
        for row, at, counts in zip(x, table.column("at"), table.column("counts")):
            row[np.frombuffer(at.as_py(), np.uint16)] = np.frombuffer(counts.as_py(), np.uint32)
            row[:] = model.vector(row)
        vectors = [c.tobytes() for c in _cluster(x, CENTROIDS)]
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(vectors), pa.string()), "place": pa.array(range(len(vectors)), pa.int32()), "vector": pa.array(vectors, pa.binary())})

    found = sorted(sample.groupBy("lang").applyInArrow(clustered, "lang string, place int, vector binary").collect())
    if found:
        model.languages = [r["lang"] for r in found]
        model.vectors = np.array([np.frombuffer(r["vector"], np.float32) for r in found])
    return model


def _own_cosines(model: Centroids, batches):
    """Counts of the binned cosines that labelled rows have with their own language, by length class."""
    of = {lang: model.vectors[[x == lang for x in model.languages]] for lang in set(model.languages)}
    found = np.zeros((32, _BINS + 1), np.int64)
    for batch in sliced(batches, 1):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts, letters = ngram_counts(text.as_py())
            if letters and lang in of:
                found[_length_class(letters), _bin(float(np.max(of[lang] @ model.vector(counts))))] += 1
    at = np.nonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(found[at], pa.int64())], names=["class", "bin", "n"])


def _bin(cosine: float) -> int:
    return int(min(1.0, max(0.0, cosine)) * _BINS)


def _low(counted) -> list[float]:
    """The ``LOW`` quantile for each length class, from (class, bin, n); classes are pooled up to ``POOL`` rows."""
    found = np.zeros((32, _BINS + 1), np.int64)
    for k, b, n in counted:
        found[k, b] += n
    used = np.flatnonzero(found.any(axis=1)).tolist()
    pools: list[list[int]] = []
    for k in used:
        if pools and found[pools[-1]].sum() < POOL:
            pools[-1].append(k)
        else:
            pools.append([k])
    if len(pools) > 1 and found[pools[-1]].sum() < POOL:
        last = pools.pop()
        pools[-1] += last
    low = [0.0] * 32
    for pool in pools:
        so_far = np.cumsum(found[pool].sum(axis=0))
        value = int(np.searchsorted(so_far, int(LOW * so_far[-1]), "right")) / _BINS
        low[pool[0] :] = [value] * (32 - pool[0])
    return low


def with_language(df: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score``, ``rejected``, from ``text_col`` alone."""
    added = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    keep = [c for c in df.columns if c not in added]
    schema = df.select(*keep).schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    at = len(keep)

    def run(batches):
        for batch in sliced(batches, at):
            found = [model.predict(t.as_py()) for t in batch.column(at)]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(batch.columns[:at] + new, names=keep + list(added))

    return df.select(*keep, df[text_col].alias("_lang_text")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op9_langid(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = fit_centroids(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return with_language(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
