"""Progress of streams as rows: what each batch read, wrote and took, with the metrics a stream observes of itself."""

from __future__ import annotations

import json
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, run string, batch long, at timestamp, input_rows long, seconds double, metrics map<string,string>"


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """``df`` with aggregates that each batch reports under ``name``: they are counted in the pass that is made anyway."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()])


class ProgressLog(StreamingQueryListener):
    """A listener that keeps the last ``most`` progress rows; ``spark.streams.addListener`` it before a query starts."""

    def __init__(self, most: int = 10_000):
        self.most, self.rows, self.lock = most, [], threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        metrics = {f"{name}.{k}": json.dumps(v, default=str) for name, row in (p.observedMetrics or {}).items() for k, v in row.asDict().items()}
        row = (p.name, str(p.runId), p.batchId, p.timestamp, p.numInputRows, (p.batchDuration or 0) / 1000, metrics)
        with self.lock:
            self.rows = [*self.rows, row][-self.most :]

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """The rows so far: query, run, batch, at, input_rows, seconds, metrics."""
        with self.lock:
            rows = list(self.rows)
        kind = SCHEMA.replace("at timestamp", "at string")
        return spark.createDataFrame(rows, kind).withColumn("at", F.col("at").cast("timestamp"))
