"""Files of any store that Arrow's file systems open, read in pieces inside tasks: content hashes of any length, and uploads taken in once."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gatelight.sources.media import kind_of
from gatelight.workers import ship

CHUNK = 8 << 20


def located(path: str):
    """(file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    if local := re.match(r"file:/*(/.*)|(/.*)", path):
        return fs.LocalFileSystem(), local[1] or local[2]
    scheme, authority, rest = re.fullmatch(r"([a-z0-9+.-]+)://([^/]*)(/.*)", path).groups()
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, base.rstrip("/") + rest


def digest(path: str, algorithm: str = "sha256", chunk: int = CHUNK) -> tuple[int, str]:
    """Length and hash of a file, read ``chunk`` bytes at a time: a file of any size takes the memory of one piece."""
    system, at = located(path)
    found, length = hashlib.new(algorithm), 0
    with system.open_input_stream(at, buffer_size=0) as stream:
        while piece := stream.read(chunk):
            found.update(piece)
            length += len(piece)
    return length, found.hexdigest()


def hashed(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """``files`` (path, ...) plus ``sha256``, the hash of what each path holds. Works on tables and on streams."""
    names = files.columns

    def run(batches):
        for batch in batches:
            found = [digest(p, algorithm)[1] for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*names, "sha256"])

    ship(files.sparkSession)
    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("sha256", T.StringType())]))


def _listed(df: DataFrame) -> DataFrame:
    """Path, kind and size; the content is never asked for, so that the scan does not open the files."""
    return df.select("path", kind_of(F.col("path")).alias("kind"), F.col("length").alias("size_bytes"), "modificationTime")


def content_hashes(spark: SparkSession, path: str, files_per_task: int = 16) -> DataFrame:
    """Files under ``path`` with kind, size and content hash, of any length; empty files are no content and are not listed. A listing is small beside what it lists: it is dealt so that a task hashes few files."""
    found = _listed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)).drop("modificationTime")
    tasks = max(1, -(-found.count() // files_per_task))
    return hashed(found.repartition(tasks, F.xxhash64("path")))


def uploads(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Stream of the files that come to a folder, each content once: asset_id (the start of its hash), path, kind, size_bytes, sha256.

    Duplicates are dropped by hash, which the state store keeps: the same content uploaded again, under any name and after any restart, is no new asset.
    Files of no known kind are left out.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    came = _listed(stream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)).filter("kind is not null")
    return hashed(came).dropDuplicates(["sha256"]).select(F.substring("sha256", 1, 16).alias("asset_id"), "path", "kind", "size_bytes", "sha256")


def ingest(assets: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Register the assets of a stream in ``table`` (Parquet, one folder a batch); a batch that is tried again overwrites its own folder."""

    def register(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return assets.writeStream.foreachBatch(register).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
