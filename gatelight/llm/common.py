"""Shared pieces of the corpus operators: shared scratch tables, text constants and a skew-proof lookup join."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import ExitStack

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelight.workers import ship  # noqa: F401  the operators take it from here

#: The six ASCII white-space characters that separate words, and the two patterns built from them.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key is heavy when it holds more than 1/PARTS of all rows, so there are fewer than PARTS heavy keys at any input size.
PARTS = 1000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the session's checkpoint folder. In local mode alone a folder of this machine will do.

    Raises ValueError on a cluster without ``spark.checkpoint.dir``: executors could not read what is written on the driver's machine.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gatelight-"))
    return context.getCheckpointDir()


class _Held:
    """A setting of a session that holds while any write of the package that asks for it runs, and is then as it was, whatever order the writes end in."""

    lock = threading.Lock()
    held: dict[tuple[str, str], tuple[int, str | None]] = {}  # by session and key: writes that run, the setting before them

    def __init__(self, spark: SparkSession, key: str, value: str):
        self.spark, self.key, self.value, self.own = spark, key, value, (spark._jsparkSession.sessionUUID(), key)

    def __enter__(self):
        with self.lock:
            running, before = self.held.get(self.own) or (0, self.spark.conf.get(self.key, None))
            self.held[self.own] = running + 1, before
            self.spark.conf.set(self.key, self.value)

    def __exit__(self, *_):
        with self.lock:
            running, before = self.held.pop(self.own)
            if running > 1:
                self.held[self.own] = running - 1, before
            elif before is None:
                self.spark.conf.unset(self.key)
            else:
                self.spark.conf.set(self.key, before)


class _Cleanup(_Held):
    """Shuffle files are removed at the end of a write."""

    KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        super().__init__(spark, self.KEY, "true")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Tables written once to the shared folder: they cut lineage, survive lost executors and are computed a single time.

    Once a table is written its query's shuffle files are of no use; Spark is told to remove them at the end of the write. An operator drops
    the tables that its result does not read (``drop``, ``only``); those that it reads go with the application, or with ``close``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gatelight-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[DataFrame] = []

    def _path(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str = "t", batch_rows: int | None = None) -> DataFrame:
        """``df`` written and read again; ``batch_rows``: at most so many rows come to Python at a time, where rows hold whole texts."""
        if not self.count:
            path, files = self._path(self.root)
            files.deleteOnExit(path)
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        with ExitStack() as settings:
            settings.enter_context(_Cleanup(self.spark))
            if batch_rows:
                most = int(self.spark.conf.get(BATCH_ROWS))
                settings.enter_context(_Held(self.spark, BATCH_ROWS, str(min(batch_rows, most) if most > 0 else batch_rows)))
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            path, files = self._path(table._scratch_path)
            files.delete(path, True)
        self.tables = [t for t in self.tables if all(t is not x for x in tables)]

    def only(self, *tables: DataFrame) -> None:
        """Delete all tables but these, which the result reads."""
        self.drop(*[t for t in self.tables if all(t is not x for x in tables)])

    def close(self) -> None:
        """Delete everything. Results that read from here can no longer be read."""
        path, files = self._path(self.root)
        files.delete(path, True)
        self.tables = []


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII values take the engine's fast path, where both definitions agree."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Array of the white-space separated words of a text; null gives an empty array."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_RUN))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def hash128(*values: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with unlike seeds; together they stand for the value."""
    return F.xxhash64(*values), F.xxhash64(F.lit(7919), *values)


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], weights: DataFrame, weight: str, spread: list[str], parts: int = PARTS, how: str = "inner") -> DataFrame:
    """Inner or left join of ``left`` with ``right`` (unique on ``keys``), dealt evenly whatever the skew.

    ``weights`` is a written table with ``keys`` and ``weight``, the number of left rows of a key. A key with more than 1/parts of
    them is heavy: its left rows are spread over so many salts that each has 1/parts of all rows at most, and its right row is repeated for each. Shares sum to one, so under
    ``parts`` keys are heavy, and salts number under ``2 * parts`` in all; the heavy keys' hashes and salts are all that the driver learns. ``spread``
    names left columns whose hash picks the salt. Keys must have the same types on all sides.
    """
    total = weights.agg(F.sum(weight)).first()[0] or 0
    key = F.xxhash64(*keys)
    heavy = {r["h"]: -(-r["w"] * parts // total) for r in weights.filter(F.col(weight) * parts > total).select(key.alias("h"), F.col(weight).alias("w")).collect()}
    if not heavy:
        return left.join(right, keys, how)
    salts = F.when(key.isin(list(heavy)), F.element_at(F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair]), key)).otherwise(1).cast("int")
    dealt = left.withColumn("_salts", salts).withColumn("_salt", F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(*spread), F.col("_salts"))).otherwise(0).cast("int")).drop("_salts")
    repeated = right.withColumn("_salts", salts).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")
