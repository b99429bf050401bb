"""Streams over the append-only audit feed and the job queue. State is bounded by watermarks; sinks are idempotent per batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ATTEMPTS = 3


def audit_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def rolling_counts(events: DataFrame, at: str = "at", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events per window and action. Works on a stream and on a table alike; in a stream events later than ``late`` are dropped."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_at", late)
    out = timed.groupBy(F.window("_at", window).alias("w"), "action").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "failure").alias("failures"))
    return out.select(F.col("w.start").alias("window_start"), "action", "n", "failures")


def append_once(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's closed windows to ``path``; a restart repeats nothing."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dispatch(handlers: dict[str, Callable[[DataFrame], DataFrame]], kind: str = "job_type") -> Callable[[DataFrame], DataFrame]:
    """A ``handle`` for ``consume_jobs`` that gives each job to the handler of its ``kind``; jobs of no known kind come out as failed."""

    def handle(batch: DataFrame) -> DataFrame:
        known = F.coalesce(F.col(kind).isin(*handlers), F.lit(False))
        unknown = batch.filter(~known).select("job_id", F.lit("failed").alias("status"))
        return reduce(DataFrame.unionByName, [run(batch.filter(F.col(kind) == name)).select("job_id", "status") for name, run in handlers.items()], unknown)

    return handle


def consume_jobs(jobs: DataFrame, handle, results: str, checkpoint: str) -> StreamingQuery:
    """Run ``handle(batch)`` on each micro-batch of jobs and write its rows under the batch's number.

    A batch that is retried overwrites its own folder, so results count once. Of several listings of a job the one of most attempts holds; one listed more than
    ``ATTEMPTS`` times (``attempt`` column) is not run again and comes out as dead. ``leases`` counts attempts itself.
    """

    def run(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != "job_id"]
        once = batch.groupBy("job_id").agg(F.max_by(F.struct(*rest), "attempt").alias("r")).select("job_id", *[f"r.{c}" for c in rest])
        done = handle(once.filter(F.col("attempt") <= ATTEMPTS))
        dead = once.filter(F.col("attempt") > ATTEMPTS).select("job_id", F.lit("dead").alias("status"))
        done.select("job_id", "status").unionByName(dead).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
