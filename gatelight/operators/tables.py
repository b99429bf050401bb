"""Changes to stored tables: retention, cascades and upserts that rewrite only the partitions they touch.

A table is a folder of Parquet partitioned by its own columns. A change reads the partitions that it may touch (by their own values, so the others
are not opened), writes what stays or comes anew to a staging folder beside the table, and puts it in place of those partitions alone by a dynamic partition
overwrite. The counts that a caller wants come from an ``Observation`` in the same pass. Repeating a change finds nothing left to do. A change that dies before
its overwrite has changed nothing; one that dies in it may have changed some partitions and not others, and repeating it finishes it. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class StoredTable:
    """A Parquet table under ``path``, partitioned by ``parts`` (columns of the table)."""

    def __init__(self, spark: SparkSession, path: str, parts: list[str]):
        self.spark, self.path, self.parts = spark, path, parts

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        rows.write.partitionBy(*self.parts).parquet(self.path)

    def _in(self, touched: DataFrame) -> DataFrame:
        """The table's rows in the ``touched`` partitions; the join's keys are partition columns, so Spark prunes the scan by their values."""
        marked = touched.select(*[F.col(p).alias(f"_{p}") for p in self.parts]).distinct()
        same = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in self.parts]
        return self.read().join(F.broadcast(marked), same, "left_semi")

    def _replace(self, rows: DataFrame, touched: DataFrame) -> None:
        """Put ``rows`` in place of the ``touched`` partitions: staged first, as they are read from the same folder."""
        staging = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}__staging-{uuid.uuid4().hex}")
        files = staging.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            rows.write.partitionBy(*self.parts).parquet(f"{staging.toString()}/rows")
            marks = touched.select(*self.parts).distinct().collect()  # partitions that change, not rows
            ready = self.spark.read.schema(self.read().schema).parquet(f"{staging.toString()}/rows")
            ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.parts).parquet(self.path)
            left = {tuple(r) for r in ready.select(*self.parts).distinct().collect()}
            for mark in marks:  # a partition without rows left is none that an overwrite would name
                if tuple(mark) not in left:
                    files.delete(self._partition(mark), True)
        finally:
            files.delete(staging, True)

    def _partition(self, values):
        name = lambda v: "__HIVE_DEFAULT_PARTITION__" if v is None else self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(v))
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *[f"{p}={name(v)}" for p, v in zip(self.parts, values)]]))

    def delete(self, doomed: Column) -> int:
        """Delete the rows for which ``doomed`` holds (null: they stay); the number deleted. Only partitions that hold such a row are rewritten."""
        gone = F.coalesce(doomed, F.lit(False))
        touched = self.read().filter(gone).select(*self.parts).distinct()
        return self._rewritten(touched, lambda rows: rows.withColumn("_gone", gone))

    def delete_keys(self, keys: DataFrame, on: str) -> int:
        """Delete the rows whose ``on`` is among ``keys``, as a cascade does; the number deleted. Null keys delete nothing."""
        marked = keys.select(F.col(on).alias("_key")).filter("_key is not null").distinct()
        touched = self.read().join(marked, F.col(on) == F.col("_key"), "left_semi").select(*self.parts).distinct()
        flag = marked.withColumn("_hit", F.lit(True))
        return self._rewritten(touched, lambda rows: rows.join(flag, F.col(on) == F.col("_key"), "left").drop("_key").withColumn("_gone", F.coalesce("_hit", F.lit(False))).drop("_hit"))

    def _rewritten(self, touched: DataFrame, mark) -> int:
        rows = touched.collect()
        if not rows:
            return 0
        touched = self.spark.createDataFrame(rows, touched.schema)
        seen = Observation()
        marked = mark(self._in(touched)).observe(seen, F.count_if("_gone").alias("deleted"))
        self._replace(marked.filter(~F.col("_gone")).drop("_gone"), touched)
        return seen.get["deleted"]

    def upsert(self, rows: DataFrame, keys: list[str], at: str, tie: str) -> dict[str, int]:
        """Put ``rows`` (columns of the table) in place of those with their ``keys``, the latest by ``at`` and ``tie`` of each key: numbers inserted and updated.

        The table's own row stays where it is later than what comes. A key whose partition values change moves: its old partition is rewritten too. Rows of
        one key that the table holds several of are settled to one. Keys must not be null.
        """
        rest = [c for c in rows.columns if c not in keys]
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(*keys, *[f"r.{c}" for c in rest])
        came = latest.select(*self.read().columns)
        held = self.read().join(came.select(*keys), keys, "left_semi")
        marks = held.select(*self.parts).unionByName(came.select(*self.parts)).distinct().collect()
        if not marks:
            return {"inserted": 0, "updated": 0}
        touched = self.spark.createDataFrame(marks, came.select(*self.parts).schema)
        both = self._in(touched).withColumn("_new", F.lit(False)).unionByName(came.withColumn("_new", F.lit(True)))
        order = F.struct(F.col(at), F.col(tie), F.col("_new"))
        columns = [c for c in both.columns if c not in (*keys, "_new")]
        settled = both.groupBy(*keys).agg(F.max_by(F.struct(*columns, "_new"), order).alias("r"), F.bool_or(~F.col("_new")).alias("had")).select(*keys, *[f"r.{c}" for c in columns], "r._new", "had")
        seen = Observation()
        counted = settled.observe(seen, F.count_if(F.col("_new") & ~F.col("had")).alias("inserted"), F.count_if(F.col("_new") & F.col("had")).alias("updated"))
        self._replace(counted.select(*self.read().columns), touched)
        return dict(seen.get)


def purge(table: StoredTable, at: str, before: Column) -> int:
    """Retention: delete the rows whose ``at`` lies before a time. Partitioned by day of ``at``, all but one of the rewritten partitions just go."""
    return table.delete(F.col(at) < before)
