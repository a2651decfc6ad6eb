"""Makes the package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
#: Rows go to Python in batches of 10,000; long documents would make them huge in the memory outside the heap.
_BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "12m")


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the workers, once a context, unless PYTHONPATH already names it; and bounds
    the bytes of an Arrow batch where the session does not."""
    root = _PACKAGE.parent
    sc = spark.sparkContext
    name, most = _BATCH_BYTES
    if not spark.sql("SET").where(f"key = '{name}'").head(1):
        spark.conf.set(name, most)
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_sidelight_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="sidelight-"), "sidelight.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(path)
    sc._sidelight_shipped = True
    return spark


@contextmanager
def cancellable(spark: SparkSession, what: str) -> Iterator[None]:
    """An interrupt cancels the jobs started inside, queued tasks included, before it goes on."""
    sc, group = spark.sparkContext, f"sidelight-{uuid.uuid4().hex[:12]}"
    sc.setJobGroup(group, what, interruptOnCancel=True)
    try:
        yield
    except BaseException:
        sc.cancelJobGroup(group)
        raise
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
