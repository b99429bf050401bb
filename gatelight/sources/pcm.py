"""PCM audio as a Spark data source: ``spark.read.format("pcm_energy").load(folder)`` after ``register(spark)``.

A file is read in slices of its steps by as many tasks, each of which seeks to its own samples: a recording of any length is neither one task
nor one value in memory. The folder must be mounted alike on driver and executors; elsewhere use ``media.audio_energy``.
"""

from __future__ import annotations

import wave
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gatelight.sources.media import energy_of, hop_and_window, mono
from gatelight.workers import ship

SLICE_BYTES = 32 << 20
BATCH_STEPS = 4096


@dataclass
class Slice(InputPartition):
    path: str
    part: int
    parts: int


class EnergyReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.fps = options["path"], float(options.get("fps", 8))
        self.start, self.seconds = float(options.get("start", 0)), float(options.get("seconds", "inf"))
        self.slice_bytes = int(options.get("sliceBytes", SLICE_BYTES))

    def partitions(self):
        found = sorted(p for p in Path(self.folder).rglob("*") if p.suffix.lower() == ".wav")
        sized = [(str(p), max(1, -(-p.stat().st_size // self.slice_bytes))) for p in found]
        return [Slice(path, part, parts) for path, parts in sized for part in range(parts)]

    def read(self, partition):
        if partition is None:  # a folder without recordings
            return
        with wave.open(partition.path) as w:
            width, channels, hz, count = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.getnframes()
            hop, window, steps = hop_and_window(count, hz, self.fps)
            first = max(0, int(np.ceil(self.start * hz / hop - 1e-9)))
            last = int(min(steps, np.ceil((self.start + self.seconds) * hz / hop - 1e-9))) if self.seconds != float("inf") else steps
            held = max(0, last - first)
            lo, hi = (first + held * k // partition.parts for k in (partition.part, partition.part + 1))
            for at in range(lo, hi, BATCH_STEPS):
                n = min(BATCH_STEPS, hi - at)
                w.setpos(at * hop)
                x = mono(w.readframes((n - 1) * hop + window), width, channels)
                i = np.arange(at, at + n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(i), pa.array(i * hop / hz), pa.array(energy_of(x, n, hop, window))], names=["path", "i", "t", "energy"])


class PcmEnergy(DataSource):
    """Rows path, i, t, energy of every WAV file under the folder, as ``media.audio_energy`` gives them.

    Options: ``fps`` (steps a second, 8), ``start`` and ``seconds`` (only steps of that window are read), ``sliceBytes`` (of a file a task, 32 MB).
    """

    @classmethod
    def name(cls) -> str:
        return "pcm_energy"

    def schema(self) -> str:
        return "path string, i int, t double, energy double"

    def reader(self, schema) -> DataSourceReader:
        return EnergyReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PcmEnergy)
