"""Speech and energy envelopes of PCM audio: one row per file and hop, files spread over tasks, each file whole in its task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelight.workers import ship

from .media import wav_samples

#: The speech band, the order of its filter, and what loudness, band share and zero crossings count.
BAND, ORDER, FLOOR_DB = (300.0, 3400.0), 4, -60.0
WINDOW_S, LEAST_S, SPEECH_S, ENERGY_S = 0.05, 0.1, 0.3, 0.15
SHARE, VOICED, GATE, WEIGHTS = (0.35, 0.35), (0.10, 0.16), (0.12, 0.55), (0.55, 0.25, 0.20)


def speech_band(x: np.ndarray, hz: int) -> np.ndarray:
    """``x`` through a Butterworth band-pass forwards and backwards, so without delay.

    Running such a filter both ways multiplies the spectrum by its squared gain, which has a closed form; that is done here on the spectrum of
    the signal, mirrored at both ends so that they do not ring into each other.
    """
    low, high = max(1e-3, 2 * BAND[0] / hz), min(0.99, 2 * BAND[1] / hz)
    if low >= high or not len(x):
        return x
    a, b = np.tan(np.pi * low / 2), np.tan(np.pi * high / 2)
    pad = min(len(x) - 1, hz // 10)
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    w = np.tan(np.pi * np.fft.rfftfreq(len(long)))
    with np.errstate(divide="ignore", over="ignore"):
        gain = 1 / (1 + ((w * w - a * b) / (w * (b - a))) ** (2 * ORDER))
    return np.fft.irfft(np.fft.rfft(long) * gain, len(long))[pad : pad + len(x)]


def smoothed(x: np.ndarray, width: int) -> np.ndarray:
    """``x`` under a Hann window of ``width`` steps, zeros beyond the ends; unchanged if shorter than the window."""
    if width <= 1 or len(x) < width:
        return x
    window = np.hanning(width)
    return np.convolve(x, window / window.sum(), mode="same")


def features(x: np.ndarray, hz: int, fps: float) -> pd.DataFrame:
    """t, energy and speech (both 0 to 1) per hop of 1 / fps; no row for under a tenth of a second of sound.

    A step's speech is its loudness over the clip's own floor times a blend of its share of the speech band and of how near its zero crossings
    are to those of voices. Window sums come from running sums over the whole signal.
    """
    if len(x) < hz // 10:
        return pd.DataFrame({"t": [], "energy": [], "speech": []}, dtype=float)
    hop = max(1, round(hz / fps))
    size = min(len(x), max(2 * hop, int(hz * WINDOW_S)))
    start = np.arange(max(1, (len(x) - size) // hop + 1)) * hop
    total = lambda v, n: (lambda run: run[start + n] - run[start])(np.concatenate([[0.0], np.cumsum(v)]))
    rms = np.sqrt(np.maximum(total(x * x, size), 0) / size)
    band = speech_band(x, hz)
    in_band = np.sqrt(np.maximum(total(band * band, size), 0) / size)
    crossings = total(np.append(np.diff(np.signbit(x).astype(np.int8)) != 0, False).astype(float), size - 1) / max(size - 1, 1)
    energy = (np.clip(20 * np.log10(np.maximum(rms, 1e-10)), FLOOR_DB, 0) - FLOOR_DB) / -FLOOR_DB
    share = np.clip((in_band / np.maximum(rms, 1e-10) - SHARE[0]) / SHARE[1], 0, 1)
    voiced = np.clip(1 - np.abs(crossings - VOICED[0]) / VOICED[1], 0, 1)
    floor, ceiling = np.percentile(energy, [25, 95])
    span = max(ceiling - floor, 1e-3)
    level = np.clip((energy - floor - GATE[0] * span) / (GATE[1] * span), 0, 1)
    speech = np.clip(level * (WEIGHTS[0] * share + WEIGHTS[1] * voiced + WEIGHTS[2]), 0, 1)
    return pd.DataFrame({"t": start / hz, "energy": smoothed(energy, max(3, round(fps * ENERGY_S))), "speech": smoothed(speech, max(3, round(fps * SPEECH_S)))})


def audio_features(spark: SparkSession, path: str, fps: float) -> DataFrame:
    """``features`` of every WAV file under ``path``: path, i, t, energy, speech. Resample onto other times with ``asof.interpolate``."""

    def run(batches):
        for rows in batches:
            for r in rows.itertuples():
                found = features(*wav_samples(r.content), fps)
                found.insert(0, "i", np.arange(len(found), dtype=np.int32))
                found.insert(0, "path", r.path)
                yield found

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", F.col("content"))
    return files.mapInPandas(run, "path string, i int, t double, energy double, speech double")
