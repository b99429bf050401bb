"""Uncompressed frames as a Spark data source: ``spark.read.format("raw_frames").load(folder)`` after ``register(spark)``.

Reads YUV4MPEG2 films (.y4m: 4:2:0, 4:2:2, 4:4:4 or grey, 8 bit) and netpbm pictures (.ppm, .pgm, binary) from any store that Arrow's file systems open. All frames of
a film have one size, so a task seeks to those of its own range, and only frames inside the window that the options name, and of those only every
``stride``-th, are read at all. The window is an option and not a pushed filter: in Spark 4.1.2 what one query has pushed stays with the relation of a Python source, and a
later query of the same DataFrame without that filter would miss rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gatelight.sources.store import located
from gatelight.workers import ship

RANGE_BYTES = 64 << 20
BATCH_BYTES = 16 << 20
MARK = b"FRAME\n"
#: Share of the luma plane's samples that each chroma plane has, across and down, by colour space.
CHROMA = {"420": (2, 2), "422": (2, 1), "444": (1, 1), "mono": None}


@dataclass
class Film:
    """Where the frames of a file lie."""

    path: str
    width: int
    height: int
    fps: float
    first: int  # byte of the first frame
    size: int  # bytes of a frame, its mark included
    count: int
    space: str  # a key of CHROMA, or rgb and grey for pictures


def film_of(path: str) -> Film:
    system, at = located(path)
    length = system.get_file_info(at).size
    with system.open_input_file(at) as f:
        head = f.read(min(length, 4096))
    if path.lower().endswith(".y4m"):
        line = head[: head.index(b"\n")].decode("ascii")
        words = {w[0]: w[1:] for w in line.split(" ")[1:] if w}
        w, h, rate = int(words["W"]), int(words["H"]), Fraction(words.get("F", "25:1").replace(":", "/"))
        space = next((s for s in CHROMA if words.get("C", "420").startswith(s) and "p1" not in words.get("C", "")), None)
        if not line.startswith("YUV4MPEG2") or space is None:
            raise ValueError(f"{path}: not an 8-bit film in 4:2:0, 4:2:2, 4:4:4 or grey")
        part = CHROMA[space]
        size = len(MARK) + w * h + (2 * -(-w // part[0]) * -(-h // part[1]) if part else 0)
        first = len(line) + 1
        return Film(path, w, h, float(rate), first, size, (length - first) // size, space)
    kind, w, h, most, body = re.match(rb"(P[56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", head).group(1, 2, 3, 4, 0)
    if int(most) != 255:
        raise ValueError(f"{path}: not an 8-bit picture")
    planes = 3 if kind == b"P6" else 1
    return Film(path, int(w), int(h), 1.0, len(body), int(w) * int(h) * planes, 1, "rgb" if planes == 3 else "grey")


def rgb_of(film: Film, raw: bytes) -> np.ndarray:
    """height x width x 3, 8 bit. Films are of studio range (16 to 235); chroma is repeated over the luma samples it belongs to."""
    x, (w, h) = np.frombuffer(raw, np.uint8), (film.width, film.height)
    if film.space == "rgb":
        return x.reshape(h, w, 3)
    y = x[: w * h].reshape(h, w)
    if film.space == "grey":
        return np.repeat(y[..., None], 3, axis=2)
    y = (y.astype(np.float64) - 16) * (255 / 219)
    if film.space == "mono":
        return np.repeat(np.clip(np.rint(y), 0, 255).astype(np.uint8)[..., None], 3, axis=2)
    across, down = CHROMA[film.space]
    cw, ch = -(-w // across), -(-h // down)
    u, v = (np.repeat(np.repeat(p.reshape(ch, cw), down, axis=0), across, axis=1)[:h, :w].astype(np.float64) - 128 for p in (x[w * h : w * h + cw * ch], x[w * h + cw * ch :]))
    scale = 255 / 224
    rgb = np.stack([y + 1.402 * scale * v, y - (0.344136 * u + 0.714136 * v) * scale, y + 1.772 * scale * u], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


@dataclass
class Range(InputPartition):
    film: Film
    lo: int
    hi: int


class FrameReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.stride = options["path"], int(options.get("stride", 1))
        self.wanted = float(options["fps"]) if "fps" in options else None
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 1 << 62))
        self.start, self.seconds = float(options.get("start", 0)), float(options.get("seconds", "inf"))

    def _frames(self, film: Film, lo: int, hi: int) -> list[int]:
        """Numbers of a range that the window and the stride leave; strides count from frame 0."""
        stride = max(1, round(film.fps / self.wanted)) if self.wanted else self.stride
        at = np.arange(-(-max(lo, self.first) // stride) * stride, min(hi, self.last))
        at = at[at % stride == 0]
        t = at / film.fps
        return at[(t >= self.start) & (t < self.start + self.seconds)].tolist()

    def partitions(self):
        from pyarrow import fs

        system, at = located(self.folder)
        info = system.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        lead = self.folder[: len(self.folder) - len(at)] if self.folder.endswith(at) else ""
        films = [film_of(lead + i.path) for i in sorted(found, key=lambda i: i.path) if i.path.lower().endswith((".y4m", ".ppm", ".pgm"))]
        out = []
        for film in films:
            step = max(1, self.range_bytes // film.size)
            out += [Range(film, lo, min(lo + step, film.count)) for lo in range(0, film.count, step) if self._frames(film, lo, min(lo + step, film.count))]
        return out

    def read(self, partition):
        if partition is None:
            return
        film, names = partition.film, ["path", "frame", "t", "width", "height", "rgb"]
        system, at = located(film.path)
        many = max(1, BATCH_BYTES // (film.width * film.height * 3))
        with system.open_input_file(at) as f:
            wanted = self._frames(film, partition.lo, partition.hi)
            for start in range(0, len(wanted), many):
                part, pixels = wanted[start : start + many], []
                for k in part:
                    f.seek(film.first + k * film.size)
                    raw = f.read(film.size)
                    if film.space in CHROMA:
                        if raw[: len(MARK)] != MARK:
                            raise ValueError(f"{film.path}: frame {k} is not where it should be (marks with parameters are not read)")
                        raw = raw[len(MARK) :]
                    pixels.append(rgb_of(film, raw).tobytes())
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([film.path] * n), pa.array(part, pa.int32()), pa.array([k / film.fps for k in part]), pa.array([film.width] * n, pa.int32()), pa.array([film.height] * n, pa.int32()), pa.array(pixels, pa.binary())], names=names)


class RawFrames(DataSource):
    """Rows path, frame, t, width, height, rgb (height x width x 3 bytes). Options: ``stride`` (every n-th frame), ``fps`` (the stride nearest to so many a second), ``first`` and
    ``last`` (frame numbers, the last not included), ``start`` and ``seconds`` (a window in time), ``rangeBytes`` (of a film a task)."""

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return "path string, frame int, t double, width int, height int, rgb binary"

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RawFrames)
