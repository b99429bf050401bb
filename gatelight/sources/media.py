"""Sources of the engine: file kinds, content hashes, probe output, PCM audio and sampled frames as tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelight.workers import ship

#: File suffixes by kind.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "tif", "tiff", "bmp")
VIDEO_SUFFIXES = ("mp4", "mov", "m4v", "mkv", "webm", "avi", "mpg", "mpeg")
PROBE = "struct<format:struct<duration:string,bit_rate:string,format_name:string,size:string>,streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,pix_fmt:string,r_frame_rate:string,avg_frame_rate:string,duration:string,channels:int,sample_rate:string>>>"


def kind_of(path: Column) -> Column:
    """image or video by suffix, else null."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin(*IMAGE_SUFFIXES), "image").when(suffix.isin(*VIDEO_SUFFIXES), "video")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` with kind, size and content hash, read in pieces: see ``store.content_hashes``."""
    from gatelight.sources.store import content_hashes

    return content_hashes(spark, path)


def rate(text: Column) -> Column:
    """'30000/1001' or '25' as a number; null for 0/0 and other text."""
    parts = F.split(text, "/")
    below = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.lit(1.0))
    value = F.try_divide(parts[0].try_cast("double"), below)
    return F.when(value > 0, value)


def probed(df: DataFrame, column: str) -> DataFrame:
    """Probe JSON as typed columns; stream values before container values, null where neither is stated."""
    p = df.withColumn("_p", F.from_json(column, PROBE))
    stream = lambda kind: F.try_element_at(F.filter("_p.streams", lambda s: s["codec_type"] == kind), F.lit(1))
    p = p.withColumn("_v", stream("video")).withColumn("_a", stream("audio"))
    return p.select(
        *df.columns, F.col("_v.width").alias("width"), F.col("_v.height").alias("height"),
        F.coalesce(F.col("_v.duration").try_cast("double"), F.col("_p.format.duration").try_cast("double")).alias("duration_s"),
        F.coalesce(rate(F.col("_v.avg_frame_rate")), rate(F.col("_v.r_frame_rate"))).alias("fps"),
        F.col("_v.codec_name").alias("video_codec"), F.col("_v.pix_fmt").alias("pix_fmt"), F.col("_a.codec_name").alias("audio_codec"),
        F.col("_a.channels").alias("audio_channels"), F.col("_a.sample_rate").try_cast("int").alias("audio_rate"),
        (F.col("_p.format.bit_rate").try_cast("double") / 1000).alias("bitrate_kbps"), F.col("_p.format.size").try_cast("long").alias("size_bytes"),
    )


def stderr_probed(text: Column) -> Column:
    """Duration, size and rate out of a probe's plain text, for builds that print no JSON."""
    part = lambda pattern, g=1: F.nullif(F.regexp_extract(text, pattern, g), F.lit("")).try_cast("double")
    clock = r"Duration: (\d+):(\d+):(\d+(?:\.\d+)?)"
    seconds = part(clock) * 3600 + part(clock, 2) * 60 + part(clock, 3)
    size = r"Video:.*?[ ,](\d{2,5})x(\d{2,5})"
    return F.struct(seconds.alias("duration_s"), part(size).cast("int").alias("width"), part(size, 2).cast("int").alias("height"), part(r"([\d.]+) fps").alias("fps"), part(r"bitrate: (\d+) kb/s").alias("bitrate_kbps"))


def strided(frames: DataFrame, index: str, fps: Column, wanted: float, start: int = 0) -> DataFrame:
    """Every step-th frame, step = max(1, round(fps / wanted)) with halves to even."""
    step = F.greatest(F.lit(1), F.bround(fps / wanted).cast("int"))
    return frames.filter((F.col(index) >= start) & ((F.col(index) - start) % step == 0))


def sample_indices(count: Column, most: int = 24) -> Column:
    """At most ``most`` evenly spaced frame numbers from 2 percent in to the last but one, without repeats."""
    n = F.least(F.lit(most), count)
    first, last = F.floor(count * 0.02), F.greatest(count - 2, F.lit(0))
    place = lambda k: F.floor(first + (last - first) * k / F.greatest(n - 1, F.lit(1))).cast("int")
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), place))).otherwise(F.array().cast("array<int>"))


def mono(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples in -1..1 of raw PCM frames of ``width`` bytes a sample (1, 2 or 4); channels are averaged."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    else:
        kind = {2: np.dtype("<i2"), 4: np.dtype("<i4")}[width]
        x = np.frombuffer(raw, kind) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1)


def wav_samples(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and the rate of a PCM WAV file (8, 16 or 32 bit)."""
    import io
    import wave

    with wave.open(io.BytesIO(data)) as w:
        return mono(w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels()), w.getframerate()


def hop_and_window(count: int, hz: int, fps: float) -> tuple[int, int, int]:
    """Samples from step to step, samples a step looks at, and the number of steps of a recording of ``count`` samples."""
    hop = max(1, round(hz / fps))
    window = min(max(2 * hop, round(0.05 * hz)), count)
    return hop, window, (count - window) // hop + 1 if count >= 0.1 * hz else 0


def energy_of(x: np.ndarray, steps: int, hop: int, window: int) -> np.ndarray:
    """RMS of each step in dB, over a range of 60 dB as 0 to 1."""
    power, first = np.concatenate([[0.0], np.cumsum(x * x)]), np.arange(steps) * hop
    last = np.minimum(first + window, len(x))
    rms = np.sqrt(np.maximum(power[last] - power[first], 0) / np.maximum(last - first, 1))
    return (np.clip(20 * np.log10(np.maximum(rms, 1e-10)), -60, 0) + 60) / 60


def audio_energy(spark: SparkSession, path: str, fps: float) -> DataFrame:
    """Per WAV file under ``path`` and hop: t and energy (RMS in dB over a 60 dB range, 0 to 1)."""

    def run(batches):
        for rows in batches:
            for r in rows.itertuples():
                x, hz = wav_samples(r.content)
                hop, window, n = hop_and_window(len(x), hz, fps)
                yield pd.DataFrame({"path": r.path, "i": np.arange(n, dtype=np.int32), "t": np.arange(n) * hop / hz, "energy": energy_of(x, n, hop, window)})

    ship(spark)
    files_ = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files_.mapInPandas(run, "path string, i int, t double, energy double")
