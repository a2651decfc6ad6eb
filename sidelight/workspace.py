"""Intermediate tables in the folder that driver and executors share.

A table written here cuts lineage: a lost executor costs the tasks that read it,
not the job that made it. The folder is ``spark.checkpoint.dir`` of the session;
only where that is unset (tests, notebooks) a local one is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sidelight-"))
        own = sc._jsc.sc().getCheckpointDir()
    return own.get()


_made: dict[str, SparkSession] = {}  # the folders of this process that are still there


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    jvm_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jvm_path, True)


def clear(roots: list[str] | None = None) -> None:
    """Deletes the folders of all workspaces, or of some; for when the results that read them have been read."""
    for root in list(_made) if roots is None else roots:
        if spark := _made.pop(root, None):
            try:
                _delete(spark, root)
            except Exception:  # the JVM has gone first; nothing is left to call
                pass


@contextmanager
def passing() -> Iterator[None]:
    """Workspaces that are made inside are deleted at its end: what they served has been written elsewhere by then."""
    before = set(_made)
    try:
        yield
    finally:
        clear([root for root in _made if root not in before])


atexit.register(clear)


class Workspace:
    """Names, writes, rereads and deletes the intermediate tables of one query run.

    What a returned DataFrame still reads is deleted by ``clear``, at the end of ``passing``,
    or else when Python ends; ``drop`` deletes sooner what only an inner step needed.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _made[self.root] = spark

    @property
    def alive(self) -> bool:
        return self.root in _made

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{name}-{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_workspace_path", None):
                _delete(self.spark, path)
