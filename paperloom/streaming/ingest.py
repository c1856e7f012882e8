"""Structured Streaming: job batches by priority, status log, windowed counts with late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from paperloom.plans.scratch import Scratch

# Words of a file name that put its job first.
URGENT = ("pan", "aadhaar", "aadhar", "receipt", "invoice", "bill", "cert", "certificate", "marksheet", "id", "card", "college", "exam", "admit", "admission", "fees", "fee", "salary", "form", "pass", "bonafide", "hallticket", "hall_ticket", "transcript", "degree", "diploma", "ration", "voter", "driving", "license", "passport", "challan", "bank", "statement", "document", "doc", "tuition", "screenshot", "screen", "scan", "cam")


def priority(name: Column, given: Column | None = None) -> Column:
    """0 for names of documents, 1 for others, or the caller's own."""
    own = F.when(F.lower(name).rlike("|".join(URGENT)), 0).otherwise(1)
    return own if given is None else F.coalesce(given, own)


def stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Append source over parquet files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window start, event_type, n, total) with a watermark; the same plan serves batch and stream."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def drain(source: DataFrame, mode: str = "complete") -> DataFrame:
    """What a streaming query gives once it has read all that is there; state and sink lie in the shared folder."""
    spark = source.sparkSession
    scratch = Scratch(spark)
    path = f"{scratch.root}/sink"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path if mode == "complete" else f"{path}/epoch={epoch}")

    q = source.writeStream.outputMode(mode).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(source.schema).parquet(path) if mode == "complete" else spark.read.parquet(path).select(*source.columns)


def process_jobs(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], log_path: str, state_path: str):  # noqa: ANN201
    """Start a query that works off each micro-batch by (priority, seq) and appends to the status log.

    Jobs whose work fails stay ``failed`` in the log.  The latest status per
    job is the last row of the log (records.latest).
    """

    def one(batch: DataFrame, epoch: int) -> None:
        ordered = batch.withColumn("priority", priority(F.col("image_name"))).sortWithinPartitions("priority", "seq")
        done = work(ordered)
        done.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(log_path)

    return jobs.writeStream.option("checkpointLocation", state_path).trigger(availableNow=True).foreachBatch(one).start()
