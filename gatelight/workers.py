"""The package on the Python workers: operators that run Python in tasks call ``ship`` first."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per session; they need no copy installed on their machines."""
    context = spark.sparkContext
    if getattr(context, "_gatelight_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="gatelight-"), "gatelight-package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._gatelight_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under the session's checkpoint folder; it goes with the application.

    Raises ValueError on a cluster without ``spark.checkpoint.dir``; in local mode a folder of this machine will do.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="gatelight-")
    folder = f"{root}/gatelight-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder
