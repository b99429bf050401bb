"""Who speaks, step by step: the mouths of all tracks of a clip held against the clip's sound, made comparable, and settled with hysteresis."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelight.operators import folds, sequences
from gatelight.operators.tracking import _sums, correlation, mouth_motion
from gatelight.workers import ship

#: Windows and lags in seconds, the speech below which nobody is heard, how correlation and motion count, what a track without a mouth or sound scores.
WINDOW_S, LAG_S, QUIET = 1.0, 0.25, 0.25
W_CORRELATION, W_MOTION, W_SILENT, UNMEASURED = 0.62, 0.38, 0.5, 0.05


def clip_scores(t: np.ndarray, energy: np.ndarray | None, speech: np.ndarray | None, tracks: list[tuple[np.ndarray, np.ndarray]], half: int, lag: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(presence, score) per step of each track of a clip. ``t``: the steps' times; tracks have the times and mouth apertures (NaN: none) of their detections.

    A track is present from its first detection to its last and scores nothing elsewhere. Heard: gate * (.62 * best correlation of mouth motion and energy around the
    step + .38 * mean motion), 0 where the gate is under .25. Without sound half the mean motion; without three measured apertures .05.
    """
    out, at = [], np.arange(len(t))
    lo, hi = np.maximum(at - half, 0), np.minimum(at + half + 1, len(t))
    for times, aperture in tracks:
        present = (t >= times[0] - 1e-6) & (t <= times[-1] + 1e-6)
        known = ~np.isnan(aperture)
        motion = None
        if known.sum() >= 3:
            inside = (t >= times[known][0]) & (t <= times[known][-1])
            motion = mouth_motion(np.where(inside, np.interp(t, times[known], aperture[known]), np.nan), t)
        if motion is None:
            score = np.full(len(t), UNMEASURED)
        else:
            mean = _sums(motion, lo, hi) / (hi - lo)
            score = W_SILENT * mean if energy is None else np.where(speech < QUIET, 0.0, speech * (W_CORRELATION * correlation(motion, energy, half, lag) + W_MOTION * mean))
        out.append((present, np.where(present, score, 0.0)))
    return out


def track_scores(series: DataFrame, steps: DataFrame, audio: DataFrame | None, fps: float, by: str = "clip_id") -> DataFrame:
    """Scores of the tracks at the steps they are present at: by, i, track_id, score, gate.

    ``series``: by, track_id, t, aperture (null: mouth not seen) of detections; ``steps``: by, i, t; ``audio``: by, t, energy, speech at any rate, read between its samples.
    Clips without audio rows are silent (gate 0). Each clip's tracks meet its steps and its sound in one group of a cogroup: nothing is repeated per track.
    """
    half, lag = max(3, round(WINDOW_S * fps)) // 2, max(1, round(LAG_S * fps))
    none = F.lit(None).cast("double")
    own = F.col(by).alias("own")  # a column of its own on each side: both may come from one table
    taken = steps.select(own, F.col("i").cast("long").alias("i"), F.col("t").cast("double").alias("t"), none.alias("energy"), none.alias("speech"))
    if audio is not None:
        taken = taken.unionByName(audio.select(own, F.lit(None).cast("long").alias("i"), *[F.col(c).cast("double").alias(c) for c in ("t", "energy", "speech")]))
    seen = series.select(own, F.col("track_id").cast("long").alias("track_id"), F.col("t").cast("double").alias("t"), F.col("aperture").cast("double").alias("aperture"))
    schema = T.StructType([steps.schema[by], *[T.StructField(c, k) for c, k in (("i", T.LongType()), ("track_id", T.LongType()), ("score", T.DoubleType()), ("gate", T.DoubleType()))]])
    names = schema.names

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        number = lambda table, c: table.column(c).to_numpy().astype(float)
        step = right.column("i").is_valid().to_numpy()
        t, i = number(right, "t"), number(right, "i")
        order, sound = np.flatnonzero(step)[np.argsort(i[step], kind="stable")], np.flatnonzero(~step)[np.argsort(t[~step], kind="stable")]
        energy = speech = None
        if len(sound):
            energy, speech = (np.interp(t[order], t[sound], np.nan_to_num(number(right, c)[sound])) for c in ("energy", "speech"))
        track, times, aperture = number(left, "track_id").astype(np.int64), number(left, "t"), number(left, "aperture")
        rank = np.lexsort((times, track))
        ids, first = np.unique(track[rank], return_index=True)
        pieces = [(times[p], aperture[p]) for p in np.split(rank, first[1:])] if len(ids) else []
        columns: list[list] = [[], [], [], []]
        for own, (present, score) in zip(ids, clip_scores(t[order], energy, speech, pieces, half, lag) if len(order) else ()):
            gate = np.zeros(len(order)) if speech is None else speech
            for column, values in zip(columns, (i[order][present], np.full(present.sum(), own), score[present], gate[present])):
                column.append(values)
        flat = [np.concatenate(c) if c else np.zeros(0) for c in columns]
        key = (right if right.num_rows else left).column("own").slice(0, 1).combine_chunks()
        keys = key.take(pa.array(np.zeros(len(flat[0]), np.int64)))
        return pa.Table.from_arrays([keys, pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(float)), pa.array(flat[3].astype(float))], names=names)

    ship(series.sparkSession)
    return seen.groupBy("own").cogroup(taken.groupBy("own")).applyInArrow(meet, schema)


def timeline(series: DataFrame, steps: DataFrame, audio: DataFrame | None, fps: float, by: str = "clip_id", shot: str | None = "shot_id") -> DataFrame:
    """The active speaker per step: by, i, active (track, -1 for nobody), dwell, score (the active track's share among those present, 0 without one).

    Scores of a step's present tracks become shares by ``sequences.softmax``, and ``folds.resolve`` hands the crop over only to a clear challenger after a
    dwell; in silence, or where no one is clear, the framing holds, and a cut frees it. Steps without any track are steps too. ``shot`` names the steps' shot column, whose
    numbers rise; shots are then settled each by itself.
    """
    scored = sequences.softmax(track_scores(series, steps, audio, fps, by), "score", [by, "i"])
    found = scored.groupBy(by, "i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("track_id").cast("int").alias("track"), "p"))).alias("scores"), F.max("gate").alias("gate"))
    rows = steps.select(by, F.col("i").cast("int").alias("i"), (F.col(shot) if shot else F.lit(0)).alias("shot_id")).join(found.withColumn("i", F.col("i").cast("int")), [by, "i"], "left")
    rows = rows.withColumn("gate", F.coalesce("gate", F.lit(0.0)))
    active = folds.resolve(rows, by, "scores", "gate", "shot_id", per_shot=bool(shot))
    share = F.coalesce(F.try_element_at("scores", "active"), F.lit(0.0))
    return active.join(rows.select(by, "i", "scores"), [by, "i"]).select(by, "i", "active", "dwell", share.alias("score"))
