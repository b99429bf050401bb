"""Sequence stages that need an optimiser or an inner loop per step: Arrow batches, parallel over clips."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelight.functions import boxes
from gatelight.workers import ship

MAX_MISSES, MIN_HITS = 6, 2
REACH = MAX_MISSES + 1  # frames that a track's next detection can lie after its last
IMPOSSIBLE = 1e6
PAIRS = 1_000_000  # pairs of detections priced at a time


def match_cost(a: Column, b: Column, diagonal: float) -> Column:
    """Cost of taking box ``b`` for the track last seen at ``a``; null where they cannot be one person."""
    overlap = boxes.iou(a, b)
    away = F.sqrt(F.pow(boxes.center_x(a) - boxes.center_x(b), 2) + F.pow(boxes.center_y(a) - boxes.center_y(b), 2)) / max(diagonal, 1.0)
    wa, wb = (F.greatest(boxes.width(x), F.lit(1e-6)) for x in (a, b))
    scale = F.greatest(wa, wb) / F.least(wa, wb)
    return F.when(((overlap < 0.02) & (away > 0.22)) | (scale > 2.6), None).otherwise((1 - overlap) * 0.55 + away * 1.6 + (scale - 1) * 0.25)


def costs(a: np.ndarray, b: np.ndarray, diagonal: float) -> np.ndarray:
    """The same for all pairs of two box arrays (n x 4 and m x 4), ``IMPOSSIBLE`` where ruled out."""
    a, b = a[:, None, :], b[None, :, :]
    size = lambda x: (np.maximum(x[..., 2] - x[..., 0], 0), np.maximum(x[..., 3] - x[..., 1], 0))
    (aw, ah), (bw, bh) = size(a), size(b)
    common = np.maximum(np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]), 0) * np.maximum(np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]), 0)
    whole = aw * ah + bw * bh - common
    overlap = np.divide(common, whole, out=np.zeros_like(common), where=whole > 0)
    away = np.hypot((a[..., 0] + a[..., 2] - b[..., 0] - b[..., 2]) / 2, (a[..., 1] + a[..., 3] - b[..., 1] - b[..., 3]) / 2) / max(diagonal, 1.0)
    wa, wb = np.maximum(aw, 1e-6), np.maximum(bw, 1e-6)
    scale = np.maximum(wa, wb) / np.minimum(wa, wb)
    cost = (1 - overlap) * 0.55 + away * 1.6 + (scale - 1) * 0.25
    return np.where(((overlap < 0.02) & (away > 0.22)) | (scale > 2.6), IMPOSSIBLE, cost)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of all of the smaller side, by shortest augmenting paths with potentials; cubic time."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], column = row, 0
        slack, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[column]:
            done[column] = True
            reduced = cost[owner[column] - 1] - u[owner[column]] - v[1:]
            free = ~done[1:]
            closer = free & (reduced < slack[1:])
            slack[1:][closer], back[1:][closer] = reduced[closer], column
            nxt = 1 + int(np.argmin(np.where(free, slack[1:], np.inf)))
            step = slack[nxt]
            u[owner[done]] += step
            v[done] -= step
            slack[1:][free] -= step
            column = nxt
        while column:
            owner[column] = owner[back[column]]
            column = back[column]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def possible(a: np.ndarray, b: np.ndarray, diagonal: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of boxes (4 x n each), which can be one person, and what taking them for one costs."""
    width, height = lambda x: np.maximum(x[2] - x[0], 0), lambda x: np.maximum(x[3] - x[1], 0)
    away = np.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2) / max(diagonal, 1.0)
    wa, wb = np.maximum(width(a), 1e-6), np.maximum(width(b), 1e-6)
    scale = np.maximum(wa, wb) / np.minimum(wa, wb)
    common = np.maximum(np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), 0) * np.maximum(np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]), 0)
    kept = np.flatnonzero((scale <= 2.6) & ((away <= 0.22) | (common > 0)))  # most pairs end here
    a, b, away, scale, common = a[:, kept], b[:, kept], away[kept], scale[kept], common[kept]
    whole = width(a) * height(a) + width(b) * height(b) - common
    overlap = np.divide(common, whole, out=np.zeros_like(common), where=whole > 0)
    fine = (overlap >= 0.02) | (away <= 0.22)
    return kept[fine], ((1 - overlap) * 0.55 + away * 1.6 + (scale - 1) * 0.25)[fine]


def settle(choices: list[list[tuple[int, float]]]) -> list[int | None]:
    """What each face takes of its (track, cost) choices: as many faces as can be served, at the least cost. The same shortest augmenting paths as ``assign``, on lists, for few faces."""
    names = list(dict.fromkeys(e for row in choices for e, _ in row))
    if len(choices) * len(names) > 400:
        place = {e: j for j, e in enumerate(names)}
        cost = np.full((len(choices), len(names)), IMPOSSIBLE)
        for i, row in enumerate(choices):
            for e, c in row:
                cost[i, place[e]] = c
        out: list[int | None] = [None] * len(choices)
        for i, j in assign(cost):
            if cost[i, j] < IMPOSSIBLE:
                out[i] = names[j]
        return out
    # a track of its own that nobody else may take stands for staying unserved, so that there are columns enough
    n, k = len(names), len(choices)
    rows = [dict(row) for row in choices]
    priced = [[row.get(e, IMPOSSIBLE) for e in names] + [IMPOSSIBLE] * k for row in rows]
    m = n + k
    u, v, owner = [0.0] * (k + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, k + 1):
        owner[0], column = i, 0
        slack, back, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[column]:
            done[column] = True
            row, at = owner[column], column
            prices, less, step, nxt = priced[row - 1], u[row], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    reduced = prices[j - 1] - less - v[j]
                    if reduced < slack[j]:
                        slack[j], back[j] = reduced, at
                    if slack[j] < step:
                        step, nxt = slack[j], j
            for j in range(m + 1):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    slack[j] -= step
            column = nxt
        while column:
            owner[column] = owner[back[column]]
            column = back[column]
    taken: list[int | None] = [None] * k
    for j in range(1, n + 1):
        if owner[j] and names[j - 1] in rows[owner[j] - 1]:
            taken[owner[j] - 1] = names[j - 1]
    return taken


class Tracker:
    """Track ids of detections that come in order of clip and frame, however many at a time.

    A track can be matched while its last detection lies ``REACH`` frames back at most, in the same shot. So what each detection can follow is known before any is assigned: all
    such pairs are priced at once, and the walk over frames only asks which of them still end a track. Where the cheapest tracks of a frame's faces all differ, they
    are its least-cost assignment; else ``settle`` decides among the faces.
    """

    def __init__(self, diagonal: float):
        self.diagonal, self.next_id = diagonal, 1
        self.part = -1  # of the detections held: the shot counted over all clips; then frame, box, track, and whether it ends its track
        self.held = (np.zeros(0, np.int64), np.zeros((4, 0)), [], [])

    def follow(self, new_clip: np.ndarray, new_shot: np.ndarray, frame: np.ndarray, box: np.ndarray) -> np.ndarray:
        """Ids of the next detections, which are whole frames; ``new_clip`` and ``new_shot`` say where a clip or a shot (also of a new clip) starts."""
        part = self.part + np.cumsum(new_shot)
        old = len(self.held[0])
        parts, frames, boxes_ = np.concatenate([np.full(old, self.part), part]), np.concatenate([self.held[0], frame]), np.concatenate([self.held[1], box], axis=1)
        n = len(frames)
        low = frames.min()
        key = (parts - parts[0]) * (frames.max() - low + REACH + 1) + (frames - low)
        start = np.searchsorted(key, key, "left")
        first = np.searchsorted(key, key - REACH, "left")
        # pairs of a detection and one that it may follow, in slices of about PAIRS
        later, earlier, price = [], [], []
        total = np.concatenate([[0], np.cumsum((start - first)[old:])])
        lo = old
        while lo < n:
            hi = max(lo + 1, old + int(np.searchsorted(total, total[lo - old] + PAIRS, "right")) - 1)
            many = (start - first)[lo:hi]
            b = np.repeat(np.arange(lo, hi), many)
            a = np.arange(len(b)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[lo:hi], many)
            kept, cost = possible(boxes_[:, a], boxes_[:, b], self.diagonal)
            later.append(b[kept]), earlier.append(a[kept]), price.append(cost)
            lo = hi
        later, earlier, price = (np.concatenate(x) for x in (later, earlier, price))
        order = np.lexsort((earlier, price, later))
        begin = np.searchsorted(later, np.arange(n + 1)).tolist()
        earlier, price = earlier[order].tolist(), price[order].tolist()
        track, ends = [*self.held[2], *[0] * (n - old)], [*self.held[3], *[True] * (n - old)]
        clip_starts = set((np.flatnonzero(new_clip) + old).tolist())
        frame_starts = (np.flatnonzero(np.r_[True, key[old + 1 :] != key[old:-1]]) + old).tolist()
        next_id = self.next_id
        for lo, hi in zip(frame_starts, [*frame_starts[1:], n]):
            if lo in clip_starts:
                next_id = 1
            wish: dict[int, int] = {}
            clash = False
            for j in range(lo, hi):
                for p in range(begin[j], begin[j + 1]):
                    e = earlier[p]
                    if ends[e]:
                        clash = clash or e in wish
                        wish[e] = j
                        break
            if clash:
                faces = range(lo, hi)
                choices = [[(earlier[p], price[p]) for p in range(begin[j], begin[j + 1]) if ends[earlier[p]]] for j in faces]
                wish = {e: j for e, j in zip(settle(choices), faces) if e is not None}
            for e, j in wish.items():
                track[j], ends[e] = track[e], False
            for j in range(lo, hi):
                if not track[j]:
                    track[j], next_id = next_id, next_id + 1
        keep = np.flatnonzero((parts == parts[-1]) & (frames > frames[-1] - REACH))
        self.part, self.next_id = int(parts[-1]), next_id
        self.held = (frames[keep], boxes_[:, keep], [track[i] for i in keep], [ends[i] for i in keep])
        return np.array(track[old:], dtype=np.int32)


def track_clip(frames: pd.DataFrame, diagonal: float) -> pd.DataFrame:
    """Track ids for the detections of one clip, ordered by frame: columns frame_i, face_no, x1, y1, x2, y2, shot_id.

    A cut retires all live tracks. A track unmatched for more than six frames can no longer be matched; frames without any detection, which
    have no row, count by the gap in the frame numbers. Ids count up from 1.
    """
    rows = frames.sort_values(["frame_i", "shot_id", "face_no"])
    out = rows[["frame_i", "face_no"]].reset_index(drop=True)
    if not len(rows):
        return out.assign(track_id=np.zeros(0, np.int32))
    shot = rows["shot_id"].to_numpy()
    starts = np.arange(len(rows)) == 0
    return out.assign(track_id=Tracker(diagonal).follow(starts, starts | np.r_[True, shot[1:] != shot[:-1]], rows["frame_i"].to_numpy(np.int64), rows[["x1", "y1", "x2", "y2"]].to_numpy(float).T))


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one before it; nulls are alike. The first always does."""
    code = column.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    return np.r_[True, code[1:] != code[:-1]]


def track_faces(faces: DataFrame, by: str, diagonal: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """``track_clip`` for every clip: by, frame_i, face_no, track_id, and the columns of ``faces`` named by ``keep``.

    One shuffle by clip and a sort within its tasks; clips then pass by in Arrow batches, and of a clip only the last frames are held, so that neither
    its length nor the number of clips makes a task larger. Detections without a frame number are left out; those without a shot are in one of their own.
    """
    number = [F.col(c).cast("int").alias(c) for c in ("frame_i", "face_no")]
    sides = ("x1", "y1", "x2", "y2")
    rows = faces.select(F.col(by), *number, F.col("shot_id").alias("_shot"), *[F.col(c).cast("double").alias(f"_{c}") for c in sides], *keep).filter("frame_i is not null")
    parts = int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: merged by bytes, tasks would be few for the work
    rows = rows.repartition(parts, by).sortWithinPartitions(by, "frame_i", "_shot", "face_no")
    passed = [by, "frame_i", "face_no", *keep]

    def run(batches):
        tracker, open_, last = Tracker(diagonal), None, None

        def tracked(table: pa.Table):
            nonlocal last
            whole = table if last is None else pa.concat_tables([last, table])
            clip, shot = _changes(whole.column(by)), _changes(whole.column("_shot"))
            clip, shot = (clip, clip | shot) if last is None else (clip[1:], (clip | shot)[1:])
            box = np.stack([table.column(f"_{c}").to_numpy() for c in sides])
            track = tracker.follow(clip, shot, table.column("frame_i").to_numpy().astype(np.int64), box)
            last = table.slice(table.num_rows - 1)
            yield from table.select(passed).append_column("track_id", pa.array(track, pa.int32())).combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if open_ is not None:
                table = pa.concat_tables([open_, table])
            if not table.num_rows:
                continue
            starts = np.flatnonzero(_changes(table.column(by)) | _changes(table.column("_shot")) | _changes(table.column("frame_i")))
            open_ = table.slice(int(starts[-1])).combine_chunks()  # the last frame may go on in the next batch
            if starts[-1]:
                yield from tracked(table.slice(0, int(starts[-1])).combine_chunks())
        if open_ is not None:
            yield from tracked(open_)

    ship(faces.sparkSession)
    schema = T.StructType([*[rows.schema[c] for c in passed], T.StructField("track_id", T.IntegerType())])
    return rows.mapInArrow(run, schema).select(by, "frame_i", "face_no", "track_id", *keep)


def finished(tracked: DataFrame, by: str, least: int = MIN_HITS) -> DataFrame:
    """Tracks seen often enough: hits, first and last frame."""
    return tracked.groupBy(by, "track_id").agg(F.count("*").alias("hits"), F.min("frame_i").alias("first_frame"), F.max("frame_i").alias("last_frame")).filter(F.col("hits") >= least)


def all_tracks(live: DataFrame, retired: DataFrame, by: str) -> DataFrame:
    """Live and retired tracks as one table; a track in both (retired, then reported live late) counts as its longer record."""
    both = live.select(by, "track_id", "hits", "first_frame", "last_frame").unionByName(retired.select(by, "track_id", "hits", "first_frame", "last_frame"))
    longest = both.groupBy(by, "track_id").agg(F.max(F.struct("hits", "last_frame", "first_frame")).alias("r"))
    return longest.select(by, "track_id", "r.hits", "r.first_frame", "r.last_frame")


def _sums(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of x[lo:hi] for arrays of bounds, from one running sum."""
    run = np.concatenate([[0.0], np.cumsum(x)])
    return run[hi] - run[lo]


def correlation(motion: np.ndarray, sound: np.ndarray, half: int, max_lag: int) -> np.ndarray:
    """Per step the best correlation, 0 at least, of the motion around it with the sound shifted by up to ``max_lag`` steps either way.

    All steps at once, by running sums of the products of each shift. Windows are cut at the ends of the motion; a shift that would take a window
    beyond the sound does not count there, nor do windows of under three steps or without variance.
    """
    n = len(motion)
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    size = hi - lo
    best = np.zeros(n)
    a = motion - motion.mean() if n else motion  # centred, so that the sums lose no digits
    b = sound - sound.mean() if len(sound) else sound
    mean_a, square_a = _sums(a, lo, hi) / np.maximum(size, 1), _sums(a * a, lo, hi)
    for shift in range(-max_lag, max_lag + 1):
        moved = np.zeros(n)
        source = np.arange(n) + shift
        there = (source >= 0) & (source < len(b))
        moved[there] = b[source[there]]
        mean_b = _sums(moved, lo, hi) / np.maximum(size, 1)
        common = _sums(a * moved, lo, hi) - size * mean_a * mean_b
        norm = np.sqrt(np.maximum(square_a - size * mean_a**2, 0) * np.maximum(_sums(moved * moved, lo, hi) - size * mean_b**2, 0))
        fine = (size >= 3) & (lo + shift >= 0) & (hi + shift <= len(b)) & (norm >= 1e-8)
        best = np.where(fine, np.maximum(best, common / np.where(fine, norm, 1.0)), best)
    return best


def mouth_motion(aperture: np.ndarray, t: np.ndarray) -> np.ndarray | None:
    """Motion of a mouth per step, 1 at its 95th percentile and above; None with under three measurements.

    Missing apertures are interpolated between the first and the last measured step; outside them the mouth is absent, has no motion and does not
    count for the percentile.
    """
    known = ~np.isnan(aperture)
    if known.sum() < 3:
        return None
    there = (t >= t[known][0]) & (t <= t[known][-1])
    filled = np.where(there, np.interp(t, t[known], aperture[known]), 0.0)
    motion = np.where(there, np.abs(np.gradient(filled)), 0.0)
    peak = np.percentile(motion[there], 95)
    return np.clip(motion / peak, 0, 1) if peak > 1e-6 else motion


def speaker_scores(steps: DataFrame, by: str | list[str], mouth: str, energy: str, gate: str, half: int = 5, max_lag: int = 2, present: str | None = None) -> DataFrame:
    """Per step how well a mouth's motion follows the sound: by, i, score.

    gate * (.62 * correlation + .38 * mean motion), 0 under a gate of .25. Without any sound (all ``energy`` null) half the mean motion; without a
    measured mouth .05. Steps at which the track is not ``present`` (a boolean column) score 0. ``by`` names clip and track; rows have t.
    """
    keys = [by] if isinstance(by, str) else by
    kinds = [f"{k} {steps.schema[k].dataType.simpleString()}" for k in keys]
    columns = [*keys, "i", "t", mouth, energy, gate, *([present] if present else [])]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        aperture, sound, open_, t = (rows[c].to_numpy(dtype=float) for c in (mouth, energy, gate, "t"))
        motion = mouth_motion(aperture, t)
        if motion is None:
            score = np.full(len(rows), 0.05)
        else:
            at = np.arange(len(rows))
            lo, hi = np.maximum(at - half, 0), np.minimum(at + half + 1, len(rows))
            mean = _sums(motion, lo, hi) / (hi - lo)
            heard = ~np.isnan(sound).all()
            sound, open_ = np.nan_to_num(sound), np.nan_to_num(open_)
            score = np.where(open_ < 0.25, 0.0, open_ * (0.62 * correlation(motion, sound, half, max_lag) + 0.38 * mean)) if heard else 0.5 * mean
        if present:
            score = np.where(rows[present].fillna(False).to_numpy(dtype=bool), score, 0.0)
        return pd.DataFrame({**{k: rows[k] for k in keys}, "i": rows["i"], "score": score})

    ship(steps.sparkSession)
    return steps.select(*columns).groupBy(*keys).applyInPandas(run, ", ".join([*kinds, "i int", "score double"]))
