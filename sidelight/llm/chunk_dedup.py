"""Substring dedup by content-defined chunks that a gear rolling hash chooses.

The gear hash of the last 32 bytes is taken at the end of every word. A word whose
hash is the largest of any ``WITHIN`` words in a row (the last of equals) ends a
chunk: the ``CHUNK_WORDS`` words up to it. Chunks overlap, and which are taken
depends on nearby bytes alone. Where a text repeats a few words, chunks follow that
are all equal; of such a row the first, the last, and between them one within any
``WITHIN`` words are kept.

A chunk whose 128-bit digest more than one document holds is a repeat. Two repeats of
a document whose ends are at most ``WITHIN`` words apart are joined if another document
holds them at the same distance, so that a run is not pieced together from what
different documents hold; repeats that are joined are a run, with what lies between.
``CHUNK_WORDS + WITHIN - 1`` whole words (49) that two documents share hold ``WITHIN``
ends of chunks, all of whose bytes are shared, and so a chunk that both take; in a
longer passage the chunks that both take follow each other at ``WITHIN`` words or less,
and are joined. So a passage of 51 words is always found, also where its first and
last word are glued to something else. Shorter passages of at least ``CHUNK_WORDS``
words are found by chance; the query leaves out what is measured below ``SURE_WORDS``.

Each end of a run is then extended by the words it shares with another holder of its
outermost chunk, the smallest or the largest id, whichever shares more; that is
fewer than ``WITHIN`` words, or another chunk would be there. Where both hold less of
a passage than a third document does, its run is measured short. In the smallest id
that holds a chunk, the chunk is the original; elsewhere it is a copy.

Digests, ids and positions are shuffled, and each text once by its id, for the
ends. Digests are counted with map-side combine, as are those of joined pairs, which
repeats alone have; those that repeat are a table of their own, and adaptive execution
splits a passage that a third of all documents hold.

Defined results: a text of fewer than ``CHUNK_WORDS`` words has no chunk; a text of
any length is read as a whole. Rows with one id are one document, so what they share
with each other is no repeat; rows equal in id and text are reported once. Of several
holders the smallest id is the first, and of several places in it the first one. Rows
with a null id take no part, nor have null or empty texts a chunk. An empty table gives
an empty table. Extra columns are not read; ``drop_repeated_runs`` carries them along,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sidelight.llm.columns import read
from sidelight.workspace import Workspace

CHUNK_WORDS, WITHIN = 37, 13
MIN_WORDS = CHUNK_WORDS
SURE_WORDS = CHUNK_WORDS + WITHIN - 1  # whole words of a passage that is always found
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint32)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of gear[b] << distance over the last 32 bytes, by doubling the window."""
    h, width = _GEAR[data], 1
    while width < 32:
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + (older << np.uint32(width))
        width *= 2
    return h


def word_edges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each word, and the byte after it."""
    edges = np.diff(np.concatenate(([True], _SPACE[np.frombuffer(data, np.uint8)], [True])).astype(np.int8))
    return np.flatnonzero(edges < 0), np.flatnonzero(edges > 0)


def word_chunks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of ``data``: the number of the first word, the first byte, and the byte after the last."""
    begins, ends = word_edges(data)
    first = np.empty(0, np.int64)
    if len(ends) >= CHUNK_WORDS:
        h = gear_hashes(np.frombuffer(data, np.uint8))[ends[CHUNK_WORDS - 1 :] - 1]
        n = min(WITHIN, len(h))
        last_largest = n - 1 - np.argmax(np.lib.stride_tricks.sliding_window_view(h, n)[:, ::-1], axis=1)
        first = np.unique(np.arange(len(last_largest)) + last_largest)
    return first, begins[first], ends[first + CHUNK_WORDS - 1] if len(first) else first


def _thinned(word: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which chunks are kept: all but those inside a row of equal ones that have another within reach."""
    keep = np.ones(len(word), bool)
    new = np.append(True, (digests[1:] != digests[:-1]).any(axis=1))
    begins = np.flatnonzero(new)
    for at, n in zip(begins.tolist(), np.diff(np.append(begins, len(word))).tolist()):
        if n > 2:
            last = word[at]
            for k in range(at + 1, at + n - 1):
                if word[k + 1] - last <= WITHIN:
                    keep[k] = False
                else:
                    last = word[k]
    return keep


def _chunks(batches):
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    names = ["doc", "row", "word", "start", "end", "d1", "d2"]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = (text.as_py() or "").encode()
            word, starts, ends = word_chunks(data)
            if not len(word):
                continue
            view = memoryview(data)
            digests = b"".join([xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())])
            both = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2)
            keep = _thinned(word, both)
            word, starts, ends, both = word[keep], starts[keep], ends[keep], both[keep]
            row = np.full(len(word), xxh3_64_intdigest(data), np.uint64).view(np.int64)
            for c, x in zip(cols, (np.full(len(word), doc, np.int64), row, word, starts, ends, both[:, 0], both[:, 1])):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0), pa.int64()) for c in cols], names=names)


def _joined(ws: Workspace, found: DataFrame) -> DataFrame:
    """``found`` with ``island``: repeats that another document holds at the same distance, and those between, have one."""
    by_word = Window.partitionBy("doc", "row").orderBy("word")
    near = F.collect_list(F.struct("word", "digest")).over(by_word.rangeBetween(-WITHIN, -1))
    pairs = found.withColumn("near", near).select("doc", "row", "word", "digest", F.explode("near").alias("p"))
    pairs = pairs.select(
        "doc", "row", "word", F.col("p.word").alias("back"),
        F.xxhash64("digest", "p.digest", F.col("word") - F.col("p.word")).alias("h1"), F.xxhash64(F.lit(5), "p.digest", "digest", F.col("word") - F.col("p.word")).alias("h2"),
    )
    pairs = ws.table(pairs, "pairs")
    shared = ws.table(pairs.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h1", "h2"), "joined")
    # how far back a repeat is joined; the window looks as far ahead as a join can reach
    reach = pairs.join(shared, ["h1", "h2"]).groupBy("doc", "row", "word").agg(F.min("back").alias("back"))
    spanned = F.min("back").over(by_word.rangeBetween(0, WITHIN))
    apart = ~F.coalesce(spanned <= F.lag("word").over(by_word), F.lit(False))
    marked = found.join(reach, ["doc", "row", "word"], "left").withColumn("apart", apart.cast("int"))
    return marked.withColumn("island", F.sum("apart").over(by_word)).drop("back", "apart")


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``start_byte``, ``end_byte``, ``n_words``, ``n_chunks``, ``first_doc`` (the smallest
    id that holds a chunk of the run), ``kept`` (all of the run is original here), and ``row``, a hash
    of the text; a row for each run of repeated chunks."""
    ws = Workspace(df.sparkSession, "chunks")
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    chunks = ws.table(docs.mapInArrow(_chunks, "doc long, row long, word long, start long, end long, d1 long, d2 long"), "chunks")
    repeats = ws.table(chunks.groupBy("d1", "d2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last"), "repeats")
    found = chunks.join(repeats, ["d1", "d2"]).dropDuplicates(["doc", "row", "word"])
    found = ws.table(found.select("doc", "row", "word", "start", "end", F.struct("d1", "d2").alias("digest"), "first", "last"), "found")
    ws.drop(chunks, repeats)
    mates = F.filter(F.array("first", "last"), lambda d: d != F.col("doc"))
    runs = ws.table(
        _joined(ws, found).groupBy("doc", "row", "island").agg(
            F.min("start").alias("start_byte"), F.max("end").alias("end_byte"), F.min("word").alias("from"), (F.max("word") + CHUNK_WORDS).alias("to"),
            F.count("*").alias("n_chunks"), F.min("first").alias("first_doc"), F.min(F.col("first") == F.col("doc")).alias("kept"),
            F.min_by("digest", "word").alias("digest_l"), F.min_by(mates, "word").alias("mates_l"), F.max_by("digest", "word").alias("digest_r"), F.max_by(mates, "word").alias("mates_r"),
        ),
        "runs",
    )
    added = _shared_ends(ws, docs, found, runs)
    return (
        runs.join(added, ["doc", "row", "island"], "left")
        .withColumn("n_words", F.col("to") - F.col("from") + F.coalesce("words_l", F.lit(0)) + F.coalesce("words_r", F.lit(0)))
        .where(F.col("n_words") >= min_words)
        .select(
            F.col("doc").alias("doc_id"), F.coalesce("byte_l", "start_byte").alias("start_byte"), F.coalesce("byte_r", "end_byte").alias("end_byte"),
            "n_words", "n_chunks", "first_doc", "kept", "row",
        )
    )


def _shared_ends(ws: Workspace, docs: DataFrame, found: DataFrame, runs: DataFrame) -> DataFrame:
    """For each run, the words shared with its mates beyond its ends, and the bytes to which they reach."""
    own = ["doc", "row", "island"]
    left, right = (
        runs.select(*own, F.col(at).alias("word"), F.lit(at == "from").alias("left"), F.col(f"digest_{x}").alias("digest"), F.explode(f"mates_{x}").alias("mate"))
        for at, x in (("from", "l"), ("to", "r"))
    )
    edges = left.unionByName(right)
    held = found.where("doc = first or doc = last").select("digest", F.col("doc").alias("mate"), F.col("row").alias("mate_row"), F.col("word").alias("mate_word"))
    at = F.min(F.struct("mate_row", "mate_word")).alias("at")
    mates = ws.table(
        edges.select("digest", "mate", "left").distinct().join(held, ["digest", "mate"]).groupBy("digest", "mate", "left").agg(at)
        .select("digest", "mate", "left", "at.mate_row", (F.col("at.mate_word") + F.when(F.col("left"), 0).otherwise(CHUNK_WORDS)).alias("mate_word")),
        "mates",
    )
    asked = edges.select("doc", "row", "word", "left").union(mates.select("mate", "mate_row", "mate_word", "left")).distinct()
    per_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("row", "word", "left")).alias("asked"))
    beside = docs.join(per_doc, "doc").select("doc", "text", "asked").mapInArrow(_words_beside, "doc long, row long, word long, left boolean, hashes array<long>, bytes array<long>")
    beside = ws.table(beside.dropDuplicates(["doc", "row", "word", "left"]), "beside")
    theirs = mates.join(
        beside.select(F.col("doc").alias("mate"), F.col("row").alias("mate_row"), F.col("word").alias("mate_word"), "left", F.col("hashes").alias("theirs")),
        ["mate", "mate_row", "mate_word", "left"],
    ).select("digest", "mate", "left", "theirs")
    n = F.least(F.size("hashes"), F.size("theirs"))
    differs = F.array_position(F.zip_with(F.slice("hashes", 1, n), F.slice("theirs", 1, n), lambda a, b: a == b), False)
    met = edges.join(beside, ["doc", "row", "word", "left"]).join(theirs, ["digest", "mate", "left"]).select(
        *own, "left", "bytes", F.when(differs > 0, differs - 1).otherwise(n).alias("words")
    ).where("words > 0").withColumn("byte", F.element_at("bytes", F.col("words").cast("int")))
    best = met.groupBy(*own, "left").agg(F.max_by(F.struct("words", "byte"), "words").alias("x"))
    return best.groupBy(*own).agg(*(F.max(F.when(F.col("left") == (x == "l"), F.col(f"x.{c}"))).alias(f"{c}_{x}") for x in "lr" for c in ("words", "byte")))


def _words_beside(batches):
    """For each place asked for, hashes of the words before or after it, nearest first, with the space
    between, and the byte that each reaches."""
    from xxhash import xxh3_64_intdigest

    names, kinds = ["doc", "row", "word", "left", "hashes", "bytes"], [pa.int64()] * 3 + [pa.bool_()] + [pa.list_(pa.int64())] * 2
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for batch in batches:
        out = []
        for doc, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            data = (text.as_py() or "").encode()
            row = signed(xxh3_64_intdigest(data))
            begins, ends = word_edges(data)
            for a in asked.as_py():
                if a["row"] != row:
                    continue
                at = a["word"]
                marks = begins[max(0, at - WITHIN) : at + 1][::-1] if a["left"] else ends[at - 1 : at + WITHIN]
                marks = marks.tolist()
                hashes = [signed(xxh3_64_intdigest(data[min(x, y) : max(x, y)])) for x, y in zip(marks, marks[1:])]
                out.append((doc, row, at, a["left"], hashes, marks[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)


def drop_repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with the copies (runs that are not kept) cut out of ``text_col``, at character borders."""
    runs = repeated_runs(df, id_col, text_col, min_words).where(~F.col("kept"))
    spans = runs.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias("_spans"))

    @F.pandas_udf("long")
    def row_hash(text):
        import pandas as pd
        from xxhash import xxh3_64_intdigest

        return pd.Series(np.array([xxh3_64_intdigest((t or "").encode()) for t in text], np.uint64).view(np.int64))

    @F.pandas_udf("string")
    def without(text, found):
        import pandas as pd

        def one(t, cut):
            if cut is None:
                return t
            data, at, out = t.encode(), 0, []
            for span in cut:
                out.append(data[at : span["start_byte"]])
                at = span["end_byte"]
            return b"".join([*out, data[at:]]).decode("utf-8", "ignore")

        return pd.Series([one(t, c) for t, c in zip(text, found)], dtype=object)

    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_of"))  # so that no name of df's meets one of ours
    keyed = whole.withColumn("_key", row_hash(F.col("_of")[text_col]))
    joined = keyed.join(spans, (F.col("_of")[id_col].cast("long") == F.col("_doc")) & (F.col("_key") == F.col("_row")), "left")
    text = F.col("_of")[text_col]
    cut = F.when(F.col("_spans").isNull(), text).otherwise(without(text, F.col("_spans")))
    return joined.select(*(cut.alias(c) if c == text_col else F.col("_of")[c].alias(c) for c in df.columns))


def op3_chunk_dedup(spark, sf_dir):
    return repeated_runs(read(spark, sf_dir, "documents"), min_words=SURE_WORDS).drop("row")
