"""Sinks: sidecars with their backups, logs, the duplicates report.

Sidecars lie beside the images on a file system that executors share. Each is
written to a temporary name and moved into place, so a task that is lost or run
twice leaves whole files; backups keep the first copy.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelight.functions.answers import outcome, parse_answer
from sidelight.functions.prompts import prompt
from sidelight.functions.sidecar import HAS_SUBJECT, backup_name, description_xml, folder_hint, merged, new_document, replaced, stem_of, subject_xml
from sidelight.operators.duplicates import MIN_CLUSTER, THRESHOLD, report_lines


def planned(answers: DataFrame, sidecars: DataFrame, model: str) -> DataFrame:
    """What each answer comes to, without touching a file: ``path, sidecar, status, error, context, cost, content, backup``.

    ``answers``: path, context, answer; ``sidecars``: path, sidecar, content (text, null where there is none).
    ``content`` is what to write, null for nothing; ``backup`` the name to keep the old file under.
    """
    told = parse_answer(F.col("answer.text"))
    # images of one stem share a sidecar; the first by path is written, the rest find its subject there
    joined = answers.join(sidecars.withColumnRenamed("content", "_old"), "path", "left").withColumn("sidecar", F.coalesce("sidecar", F.concat(stem_of(F.col("path")), F.lit(".xmp"))))
    fields = joined.withColumns({"_subject": subject_xml(told["keywords"]), "_told": description_xml(told["description"])})
    edited = fields.withColumn("_merge", merged(F.col("_old"), F.col("_subject"), F.col("_told")))
    firsts = edited.groupBy("sidecar").agg(F.min("path").alias("_first"))
    edited = edited.join(firsts, "sidecar")
    later = F.col("path") != F.col("_first")
    has = F.col("_old").isNotNull() | later
    error = F.when(later, F.lit(HAS_SUBJECT)).otherwise(F.col("_merge.error"))
    out = edited.withColumn("_what", outcome(F.col("answer"), F.lit(False), has, error))
    status = F.col("_what.status")
    return out.select(
        "path", "sidecar", status.alias("status"), F.col("_what.error").alias("error"),
        F.when(status.isin("merged", "created"), F.col("context")).alias("context"),
        F.when(status.isin("merged", "created"), F.coalesce("answer.cost", F.lit(0.0))).alias("cost"),
        F.when(status == "merged", F.col("_merge.content")).when(status == "created", new_document(F.col("_subject"), F.col("_told"), model)).alias("content"),
        # also where the merge then refused the document as malformed
        F.when(F.col("_old").isNotNull() & status.isin("merged", "error") & F.col("answer.text").isNotNull() & (F.size(told["keywords"]) > 0), backup_name(F.col("sidecar"))).alias("backup"),
    )


def repairs(answers: DataFrame, sidecars: DataFrame) -> DataFrame:
    """As ``planned``, for replacing the fields of tagged sidecars; no backup is made."""
    from sidelight.functions.answers import repair_outcome
    from sidelight.functions.text import has_cjk

    told = parse_answer(F.col("answer.text"))
    joined = answers.join(sidecars.withColumnRenamed("content", "_old"), "path", "left")
    edit = joined.withColumn("_edit", replaced(F.col("_old"), subject_xml(told["keywords"]), description_xml(told["description"])))
    what = repair_outcome(F.col("answer"), has_cjk(told["description"], told["keywords"]), F.col("_edit.error"))
    out = edit.withColumn("_what", what)
    status = F.col("_what.status")
    return out.select(
        "path", "sidecar", status.alias("status"), told["description"].alias("description"), told["keywords"].alias("keywords"),
        F.when(status.isin("fixed", "xmp_error"), F.coalesce("answer.cost", F.lit(0.0))).alias("cost"), F.col("_what.error").alias("error"),
        F.when(status == "fixed", F.col("_edit.content")).alias("content"), F.lit(None).cast("string").alias("backup"),
    )


def asked(pairs: DataFrame, root: str, kind: str, language: str = "English") -> DataFrame:
    """``path``, ``context``, ``prompt`` and the image's bytes (``image``) for the describing model."""
    context = folder_hint(F.col("path"), root)
    return pairs.select("path", context.alias("context"), prompt(kind, context, language).alias("prompt"), F.col("image").alias("content"))


def write_sidecars(plan: DataFrame, backup_dir: str) -> None:
    """Carries out a plan that has been written before, once for each sidecar."""

    def put(path: str, data: bytes) -> None:
        part = f"{path}.part-{uuid.uuid4().hex}"  # another host's task may write beside it
        Path(part).write_bytes(data)
        os.replace(part, path)

    def run(rows) -> None:
        for r in rows:
            if r.backup is not None and os.path.exists(r.sidecar):
                Path(backup_dir).mkdir(parents=True, exist_ok=True)
                kept = f"{backup_dir}/{r.backup}"
                if not os.path.exists(kept):
                    put(kept, Path(r.sidecar).read_bytes())
            if r.content is not None:
                put(r.sidecar, r.content.encode("utf-8"))

    plan.where("content is not null or backup is not null").select("sidecar", "content", "backup").foreachPartition(run)


def append_log(plan: DataFrame, path: str, columns=("path", "status", "error", "context", "cost")) -> None:
    """JSON lines, without keys that are null; what was already done is counted, not logged."""
    plan.where("status <> 'skipped_done'").select(*columns).write.mode("append").json(path)


def write_report(records: DataFrame, path: str, threshold: float = THRESHOLD, min_cluster: int = MIN_CLUSTER) -> None:
    """The duplicates report as one file with one JSON document, replacing an older one when it is whole."""
    spark, aside = records.sparkSession, f"{path}.part-{uuid.uuid4().hex[:12]}"
    lines = report_lines(records, threshold, min_cluster)
    lines.repartition(1).sortWithinPartitions("place").select("line").write.text(aside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    old, folder = hadoop.Path(path), hadoop.Path(aside)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = [s.getPath() for s in fs.globStatus(hadoop.Path(f"{aside}/part-*"))]
    fs.delete(old, True)
    if not fs.rename(made[0], old):
        raise OSError(f"cannot move the report to {path}")
    fs.delete(folder, True)
