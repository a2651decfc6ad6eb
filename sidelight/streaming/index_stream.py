"""The index as a stream: new records are appended once, whatever is delivered twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sidelight.operators.index import too_long


def arriving(spark: SparkSession, path: str, ddl: str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(ddl).format(kind).load(path)


def append_new(rows: DataFrame, out: str, checkpoint: str, key: str = "path", once: bool = True) -> StreamingQuery:
    """Appends rows whose key has not been seen; the seen keys are the stream's state, kept by its checkpoint."""
    writer = rows.dropDuplicates([key]).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_described(rows: DataFrame, out: str, anomalies: str, checkpoint: str) -> StreamingQuery:
    """As ``append_new``, with too long descriptions put aside; one pass over each batch writes both."""

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites what it wrote before
        odd = too_long(F.col("description"))
        batch.where(~odd).write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.where(odd).select("path", F.length("description").alias("description_len")).write.mode("overwrite").json(f"{anomalies}/batch={number}")

    return rows.dropDuplicates(["path"]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running counts and costs by status; a new table for each micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counts = events.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))
    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
