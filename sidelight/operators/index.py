"""Building the search index: records from sidecars, what is new, what is odd."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sidelight.functions.sidecar import extracted, subject_present
from sidelight.functions.text import decoded
from sidelight.functions.vectors import quantised
from sidelight.operators.logs import without
from sidelight.operators.search import keyed
from sidelight.schemas import RECORD_DDL, schema

MAX_DESCRIPTION = 1500
EMBED_BATCH = 8


def too_long(description: Column) -> Column:
    """More code points than a description has: a model's thinking aloud."""
    return F.length(description) > MAX_DESCRIPTION


def records(pairs: DataFrame, root: str, source: str) -> DataFrame:
    """Index records without vectors, of images with a described sidecar; ``pairs``: path, content (bytes)."""
    # as a generator, below which no filter moves: a filter on what is read would read every sidecar twice
    read = F.filter(F.array(extracted(decoded(F.col("content")), F.col("path"), root)), lambda x: F.coalesce(x["description"], F.lit("")) != "")
    return pairs.select("path", F.explode(read).alias("x")).select("path", "x.*", F.lit(source).alias("source"))


def untagged(pairs: DataFrame) -> DataFrame:
    """Images whose sidecar is missing or holds no subject."""
    return pairs.where(~F.coalesce(subject_present(decoded(F.col("content"))), F.lit(False))).select("path")


def pending(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """What is left to tag, in the order of discovery; the first ``limit`` of it."""
    out = untagged(pairs).orderBy(F.split("path", "/"))
    return out if limit is None else out.limit(limit)


def new_records(found: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to embed, anomalies ``path, description_len``) of what the index does not hold yet."""
    fresh = without(found, index.where(F.col("path").isNotNull()).select("path").distinct())
    odd = fresh.where(too_long(F.col("description"))).select("path", F.length("description").alias("description_len"))
    return fresh.where(~too_long(F.col("description"))), odd


class Embedder:
    """Turns texts into vectors; ``load`` runs once in each Python worker.

    ``kind`` is ``document`` or ``query``: many models want a different prefix for each.
    """

    prefixes = {"document": "", "query": ""}

    def load(self) -> Callable[[list[str]], list[list[float]]]:
        raise NotImplementedError

    def width(self) -> int:
        return len(self.load()(["x"])[0])

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]:
        model = self.load()
        prefixed = [self.prefixes[kind] + t for t in texts]
        return [v for at in range(0, len(prefixed), EMBED_BATCH) for v in model(prefixed[at : at + EMBED_BATCH])]


class HashingEmbedder(Embedder):
    """A deterministic stand-in for a model: signed hashed words, at length 1."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def load(self):
        from hashlib import blake2b

        def one(text):
            v = [0.0] * self.size
            for w in text.casefold().split():
                h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            return [x / n for x in v]

        return lambda texts: [one(t) for t in texts]

    def width(self) -> int:
        return self.size


class OnnxEmbedder(Embedder):
    """A sentence model in a folder with ``tokenizer.json`` and an ONNX file, on the CPU."""

    # The file that is preferred, and the prefixes that the model was trained with.
    files = ("model_quantized.onnx", "model.onnx")
    prefixes = {"document": "title: none | text: ", "query": "task: search result | query: "}

    def __init__(self, folder: str, output: str = "sentence_embedding") -> None:
        self.folder, self.output = folder, output

    def _session(self):
        import onnxruntime

        found = [p for p in (f"{self.folder}/{name}" for name in self.files) if os.path.exists(p)]
        if not found:
            raise FileNotFoundError(f"no embedding model in {self.folder}")
        return onnxruntime.InferenceSession(found[0], providers=["CPUExecutionProvider"])

    def load(self):
        import numpy as np
        from tokenizers import Tokenizer

        tokenizer, session = Tokenizer.from_file(f"{self.folder}/tokenizer.json"), self._session()
        tokenizer.no_padding()
        wanted = {i.name for i in session.get_inputs()}

        def run(texts):
            coded = [c.ids for c in tokenizer.encode_batch(texts)]
            ids = np.zeros((len(coded), max(map(len, coded), default=0)), np.int64)
            mask = np.zeros_like(ids)
            for k, c in enumerate(coded):  # padded on the right, to the longest of the batch
                ids[k, : len(c)], mask[k, : len(c)] = c, 1
            feed = {"input_ids": ids, "attention_mask": mask}
            return session.run([self.output], {k: v for k, v in feed.items() if k in wanted})[0].tolist()

        return run

    def width(self) -> int:
        """From the model's own description, else by a probe."""
        for out in self._session().get_outputs():
            if out.name == self.output and out.shape and isinstance(out.shape[-1], int):
                return out.shape[-1]
        return super().width()


def embedded(rows: DataFrame, embedder: Embedder) -> DataFrame:
    """Records with ``vector``, rounded to five digits. The model is loaded once a task at most."""
    columns = [f.name for f in schema(RECORD_DDL).fields if f.name != "vector"]
    told = columns.index("description")
    out = rows.select(*columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = None
        for batch in batches:
            texts = batch.column(told).to_pylist()
            if model is None and texts:
                model = embedder.load()
            prefixed = [embedder.prefixes["document"] + t for t in texts]
            vectors = [v for at in range(0, len(prefixed), EMBED_BATCH) for v in model(prefixed[at : at + EMBED_BATCH])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*columns, "vector"])

    kinds = StructType([*out.schema.fields, StructField("vector", ArrayType(DoubleType()))])
    made = out.mapInArrow(run, kinds)
    return made.withColumn("vector", quantised(F.col("vector")))


def append_index(found: DataFrame, index_path: str, anomaly_path: str, embedder: Embedder) -> None:
    """Embeds and appends what a Parquet index lacks, and logs anomalies; safe to run again after any failure.

    ``seq`` goes on from the index's largest, in the order of path components. What searching needs of a
    record is stored with it.
    """
    spark = found.sparkSession
    try:
        index = spark.read.schema(schema(RECORD_DDL).add("seq", "long")).parquet(index_path)
        last = index.agg(F.max("seq")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        index, last = spark.createDataFrame([], schema(RECORD_DDL).add("seq", "long")), None
    fresh, odd = new_records(found, index)
    odd.write.mode("append").json(anomaly_path)
    # ranges keep the order of paths; within the whole the id only has to grow with it. They are drawn from a sample of
    # the records, so the model comes after them, and sees each record once
    placed = fresh.repartitionByRange(F.split("path", "/")).sortWithinPartitions(F.split("path", "/"))
    numbered = keyed(embedded(placed, embedder)).withColumn("seq", F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1))
    numbered.write.mode("append").parquet(index_path)
