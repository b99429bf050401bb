"""Measures of frames that need no model: sharpness, bars, brightness, colour histograms and their correlation, saliency. NumPy on Arrow batches of frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatelight.workers import ship

#: Size at which histograms are taken and their bins; brightness and texture of a bar; width of a saliency map and what its parts count.
SMALL, BINS = (160, 90), 32
DARK, FLAT = 20, 6.0
WORK_WIDTH, SPECTRAL, EDGES, CENTRE = 320, 0.6, 0.4, 0.18


def grey(rgb: np.ndarray) -> np.ndarray:
    return np.floor(rgb @ np.array([0.299, 0.587, 0.114]) + 0.5)


def _mirrored(x: np.ndarray, reach: int) -> np.ndarray:
    return np.pad(x, reach, mode="reflect")


def sharpness(rgb: np.ndarray) -> float:
    """Variance of the Laplacian."""
    x = _mirrored(grey(rgb), 1)
    return float((x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]).var())


def letterbox(rgb: np.ndarray) -> float:
    """Share of the frame in dark and flat bars along its edges; 0 where all of it is dark."""
    x = grey(rgb)
    h, w = x.shape
    bars = []
    for axis in (1, 0):
        bar = (x.mean(axis=axis) < DARK) & (x.std(axis=axis) < FLAT)
        inner = np.flatnonzero(~bar)
        if not len(inner):
            return 0.0
        bars.append(inner[0] + len(bar) - 1 - inner[-1])
    down, across = bars
    return (down * w + across * h - down * across) / (w * h)


def averaged(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """A picture at another size, each sample the mean of what it covers."""

    def weights(n: int, m: int) -> np.ndarray:
        edge, cell = np.arange(m + 1) * n / m, np.arange(n)
        covered = np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell)
        return np.maximum(covered, 0) / (n / m)

    return np.einsum("ij,jk...,lk->il...", weights(x.shape[0], height), x, weights(x.shape[1], width), optimize=True)


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Hue and saturation of a small copy in 32 x 32 bins, from 0 to 1."""
    small = np.rint(averaged(rgb.astype(float), *SMALL))
    top, low = small.max(axis=2), small.min(axis=2)
    spread = np.where(top > low, top - low, 1.0)
    r, g, b = np.moveaxis(small, 2, 0)
    hue = np.where(top == r, (g - b) / spread, np.where(top == g, 2 + (b - r) / spread, 4 + (r - g) / spread)) * 30
    hue = np.where(top > low, np.rint(hue) % 180, 0)
    saturation = np.rint(np.where(top > 0, (top - low) * 255 / np.where(top > 0, top, 1), 0))
    found = np.bincount((np.minimum(hue * BINS // 180, BINS - 1) * BINS + saturation * BINS // 256).astype(int).ravel(), minlength=BINS * BINS).astype(float)
    low, top = found.min(), found.max()
    return (found - low) / (top - low) if top > low else np.zeros_like(found)


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two arrays; 1 where one of them is flat."""
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    norm = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return np.where(norm > 1e-12, (a * b).sum(axis=1) / np.where(norm > 1e-12, norm, 1.0), 1.0)


def _scaled(x: np.ndarray) -> np.ndarray:
    low, top = x.min(), x.max()
    return (x - low) / (top - low) if top - low >= 1e-8 else np.zeros_like(x)


def _blurred(x: np.ndarray, spread: float) -> np.ndarray:
    n = int(round(spread * 8 + 1)) | 1
    weights = np.exp(-((np.arange(n) - n // 2) ** 2) / (2 * spread * spread))
    weights /= weights.sum()
    for axis in (0, 1):
        reach, size = n // 2, x.shape[axis]
        at = np.arange(-reach, size + reach)
        while size > 1 and ((at < 0) | (at >= size)).any():
            at = np.where(at < 0, -at, np.where(at >= size, 2 * (size - 1) - at, at))
        wide = np.take(x, np.clip(at, 0, size - 1), axis=axis)
        x = sum(k * np.take(wide, np.arange(j, j + size), axis=axis) for j, k in enumerate(weights))
    return x


def saliency(rgb: np.ndarray) -> np.ndarray:
    """What stands out, 0 to 1, at most ``WORK_WIDTH`` wide: the residual of the log spectrum, edges, and a weak pull to the middle."""
    h, w = rgb.shape[:2]
    scale = min(1.0, WORK_WIDTH / w)
    x = grey(averaged(rgb.astype(float), round(w * scale), max(1, round(h * scale))) if scale < 1 else rgb)
    spectrum = np.fft.fft2(x)
    size = np.log(np.abs(spectrum) + 1e-8)
    wide = _mirrored(size, 1) if min(x.shape) > 1 else np.pad(size, 1, mode="edge")
    mean = sum(wide[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3)) / 9
    spectral = _scaled(_blurred(np.abs(np.fft.ifft2(np.exp(size - mean + 1j * np.angle(spectrum)))) ** 2, 2.5))
    p = _mirrored(x, 1) if min(x.shape) > 1 else np.pad(x, 1, mode="edge")
    side = p[:-2] + 2 * p[1:-1] + p[2:]
    gx, gy = side[:, 2:] - side[:, :-2], (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:])[2:] - (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:])[:-2]
    edges = _scaled(_blurred(np.hypot(gx, gy), max(2.0, x.shape[1] / 48)))
    cy, cx = x.shape[0] / 2, x.shape[1] / 2
    yy, xx = np.mgrid[0 : x.shape[0], 0 : x.shape[1]]
    pull = np.clip(1 - CENTRE * np.hypot((xx - cx) / cx, (yy - cy) / cy), 0, 1)
    return _scaled(_scaled(SPECTRAL * spectral + EDGES * edges) * pull)


def _pictures(batch: pa.RecordBatch):
    for w, h, raw in zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), batch.column("rgb").to_pylist()):
        yield np.frombuffer(raw, np.uint8).reshape(h, w, 3)


def measured(frames: DataFrame) -> DataFrame:
    """Rows path, frame, t of ``frames`` (as of ``sources.frames``) with luma, letterbox, sharpness and histogram."""

    def run(batches):
        for batch in batches:
            rows = [(float(grey(p).mean()), letterbox(p), sharpness(p), histogram(p)) for p in _pictures(batch)]
            columns = [pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("path", "frame", "t")], *columns, pa.array([r[3].tolist() for r in rows], pa.list_(pa.float64()))], names=["path", "frame", "t", "luma", "letterbox", "sharpness", "histogram"])

    ship(frames.sparkSession)
    return frames.mapInArrow(run, "path string, frame int, t double, luma double, letterbox double, sharpness double, histogram array<double>")


def frame_correlations(facts: DataFrame) -> DataFrame:
    """``facts`` (path, frame, t, histogram) with ``corr``, how a frame's histogram follows the one before it in its film; null for the first."""
    before = F.lag("histogram").over(Window.partitionBy("path").orderBy("frame"))
    pairs = facts.select("path", "frame", "t", "histogram", before.alias("before"))

    def run(batches):
        for batch in batches:
            known = np.flatnonzero(batch.column("before").is_valid().to_numpy(zero_copy_only=False))
            out = np.full(batch.num_rows, np.nan)
            if len(known):
                rows = batch.take(pa.array(known))
                out[known] = correlation(*(np.array(rows.column(c).to_pylist()) for c in ("histogram", "before")))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("path", "frame", "t")] + [pa.array(out, mask=np.isnan(out))], names=["path", "frame", "t", "corr"])

    return pairs.mapInArrow(run, "path string, frame int, t double, corr double")


def saliency_maps(frames: DataFrame) -> DataFrame:
    """Rows path, frame and ``rows`` (arrays of 0 to 1) of ``frames``, for ``crop.solve``."""

    def run(batches):
        for batch in batches:
            found = [saliency(p).tolist() for p in _pictures(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("frame"), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["path", "frame", "rows"])

    ship(frames.sparkSession)
    return frames.mapInArrow(run, "path string, frame int, rows array<array<double>>")
