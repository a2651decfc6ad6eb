"""Scans: images, their sidecars, JSON-lines indexes and logs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from threading import Lock
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidelight.functions.images import EXTENSIONS, is_image
from sidelight.functions.sidecar import stem_of
from sidelight.operators.ranks import ranked
from sidelight.schemas import DUPLICATES_DDL, RECORD_DDL, schema


@dataclass(frozen=True)
class Collection:
    """A tree of images: the whole of ``root``, or only some of its folders."""

    name: str
    root: str
    subdirs: tuple[str, ...] = ()
    reasoning: bool | None = None
    prompt: str = "photos"
    hidden: bool = False  # also what lies under names with a leading dot or underscore

    @property
    def bases(self) -> list[str]:
        return [f"{self.root.rstrip('/')}/{s}" for s in self.subdirs] or [self.root.rstrip("/")]


def _plain(path):
    """A path without its scheme, as the archive's own tools write it."""
    return F.regexp_replace(path, "^file:(?://(?=/))?", "")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def scan(spark: SparkSession, base: str, hidden: bool = False) -> DataFrame:
    """``path``, ``modificationTime``, ``length`` and ``content`` of all files under a folder, recursively.

    Files and folders whose name starts with ``.`` or ``_`` are skipped, as Spark's readers
    do; with ``hidden`` they are added. A missing folder is empty. Bytes are read only where
    a plan asks for them.
    """
    kinds = "path string, modificationTime timestamp, length bigint, content binary"
    if not _exists(spark, base):
        return spark.createDataFrame([], kinds)
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    return seen.unionByName(_hidden(spark, base)) if hidden else seen


def _hidden(spark: SparkSession, base: str) -> DataFrame:
    """The files that Spark's readers pass over: listed through Hadoop's file systems, read through Arrow's on the executors."""
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    under = len(fs.makeQualified(root).toUri().getPath().rstrip("/")) + 1
    found, every = [], fs.listFiles(root, True)
    while every.hasNext():
        status = every.next()
        if any(name[0] in "._" for name in status.getPath().toUri().getPath()[under:].split("/")):
            found.append((status.getPath().toString(), status.getModificationTime(), status.getLen()))
    listed = spark.createDataFrame(found, "path string, ms long, length long")

    def read(batches):
        from pyarrow.fs import FileSystem

        for batch in batches:
            data = []
            for uri in batch.column(0).to_pylist():
                # Hadoop writes file:/a without escapes; Arrow takes a plain path or a whole URI
                system, path = FileSystem.from_uri(uri if "://" in uri else "file://" + quote(uri.removeprefix("file:")))
                with system.open_input_stream(path) as f:
                    data.append(f.read())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=["path", "ms", "length", "content"])

    rows = listed.mapInArrow(read, "path string, ms long, length long, content binary")
    return rows.select("path", F.timestamp_millis("ms").alias("modificationTime"), "length", "content")


def images(spark: SparkSession, collection: Collection, extensions=EXTENSIONS) -> DataFrame:
    """The images of a collection: ``path``, ``modified``, ``length``, ``content``."""
    out = None
    for base in collection.bases:
        one = scan(spark, base, collection.hidden).where(is_image(F.col("path"), extensions))
        out = one if out is None else out.unionByName(one)
    return out.select(_plain(F.col("path")).alias("path"), F.col("modificationTime").alias("modified"), "length", "content")


def in_order(rows: DataFrame) -> DataFrame:
    """By path components, so that a folder's files stand together before its longer-named neighbours."""
    return rows.orderBy(F.split("path", "/"))


def with_sidecars(spark: SparkSession, collection: Collection, how: str = "left") -> DataFrame:
    """``path``, ``sidecar``, ``content`` (the sidecar's bytes): images of one stem share a sidecar."""
    cards = None
    for base in collection.bases:
        one = scan(spark, base, collection.hidden).where(F.col("path").endswith(".xmp"))
        cards = one if cards is None else cards.unionByName(one)
    return paired(images(spark, collection).select("path"), cards.select(_plain(F.col("path")).alias("sidecar"), "content"), how)


def paired(found: DataFrame, cards: DataFrame, how: str = "left") -> DataFrame:
    """Images (``path``) with the sidecar (``sidecar``, ``content``) of their stem."""
    stem = stem_of(F.col("sidecar"))
    return found.withColumn("_stem", stem_of(F.col("path"))).join(cards.withColumn("_stem", stem), "_stem", how).drop("_stem")


def configured(spark: SparkSession, collections: list[Collection]) -> list[Collection]:
    """Those whose root exists, in the given order."""
    return [c for c in collections if _exists(spark, c.root)]


def _json_lines(spark: SparkSession, path: str, ddl: str, required: str = "path") -> DataFrame:
    kinds = schema(ddl).add("_corrupt", "string")
    if not _exists(spark, path):
        return spark.createDataFrame([], schema(ddl)).withColumn("seq", F.lit(0).cast("long"))
    # partitions follow the file's bytes, so the generated id grows with the line
    rows = spark.read.schema(kinds).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.withColumn("seq", F.monotonically_increasing_id())
    return rows.where(F.col("_corrupt").isNull() & F.col(required).isNotNull()).drop("_corrupt")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines index with ``seq`` in the order of its lines; broken and blank lines are skipped."""
    return _json_lines(spark, path, RECORD_DDL)


def read_log(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return _json_lines(spark, path, ddl)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DUPLICATES_DDL).option("multiLine", "true").json(path)


def lined_up(index: DataFrame) -> DataFrame:
    """``seq`` as 0, 1, 2 ..., for what counts positions."""
    return ranked(index, ["seq"], "_place").withColumn("seq", F.col("_place") - 1).drop("_place")


def newest(spark: SparkSession, path: str) -> int:
    """When a file, or any file right in a folder, last changed; 0 where there is none."""
    sc = spark.sparkContext
    jvm_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(sc._jsc.hadoopConfiguration())
    return max((s.getModificationTime() for s in fs.listStatus(jvm_path)), default=0) if fs.exists(jvm_path) else 0


class Snapshot:
    """A table kept in memory until its files change; readers in several threads see one generation at a time."""

    def __init__(self, spark: SparkSession, path: str, load: Callable[[SparkSession, str], DataFrame]) -> None:
        self.spark, self.path, self.load = spark, path, load
        self._lock, self._seen, self._kept = Lock(), None, None

    def get(self) -> DataFrame:
        with self._lock:
            now = newest(self.spark, self.path)
            if self._kept is None or now != self._seen:
                if self._kept is not None:
                    self._kept.unpersist()
                self._seen, self._kept = now, self.load(self.spark, self.path).persist()
            return self._kept
