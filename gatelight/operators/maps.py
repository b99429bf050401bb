"""Importance maps of frames: which cells of a frame matter, and how much of it a window holds.

A map is a sum of layers: a Gaussian over each head, a soft-edged plateau over each body, and a saliency image. Each layer is a product of a profile across and a
profile down, so what a window holds of it is a product of two differences of running sums; a summed-area table of all cells, which says the same, is never
made. Frames are worked on by the batch, as arrays with the subjects of each frame in front.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelight.functions import boxes
from gatelight.workers import ship

#: Cells across a map, what the layers weigh, a head's spread in shares of its sides, a plateau's soft edge in shares of its smaller side.
CELLS = 384
BODY_WEIGHT, SALIENCY_WEIGHT, SPREAD, SOFT = 0.30, 0.18, 0.55, 0.25
ROWS = 32  # cells of a Gaussian from one that is worked out to the next
#: Kernels of 3, 5 and 7 cells; longer ones follow the bell curve.
SHORT_KERNELS = {3: (0.25, 0.5, 0.25), 5: (0.0625, 0.25, 0.375, 0.25, 0.0625), 7: (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125)}


def shape(width: int, height: int, cells: int = CELLS) -> tuple[int, int]:
    """Cells across and down."""
    across = min(cells, width)
    return across, max(1, round(across * height / width))


def face_weights(area: np.ndarray, top: np.ndarray, conf: np.ndarray) -> np.ndarray:
    """What faces count, by their area beside the largest of their frame and by confidence."""
    return np.sqrt(np.maximum(np.where(top > 0, area / np.where(top > 0, top, 1.0), 1.0), 0.02)) * (0.55 + 0.45 * conf)


def body_weights(conf: np.ndarray) -> np.ndarray:
    return BODY_WEIGHT * (0.5 + 0.5 * conf)


def bell(lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Running sums (n + 1 x m) of weighted Gaussians over m intervals, cut off at three spreads; none over an empty interval.

    From cell to cell a Gaussian changes by a factor that itself changes by a constant one; every ``ROWS`` cells both are worked out anew.
    """
    solid = (hi > lo) & np.isfinite(hi - lo)
    lo, hi, m = np.where(solid, lo, 0.0), np.where(solid, hi, 0.0), len(lo)
    middle, spread = (lo + hi) / 2, np.maximum(1.0, (hi - lo) * SPREAD)
    first, last = (np.where(solid, np.clip(v, 0, n), 0).astype(int) for v in (np.floor(middle - 3 * spread), np.ceil(middle + 3 * spread)))
    rate = 1 / (spread * spread)
    slower = np.exp(-rate)
    out = np.empty((n + 1, m))
    out[0] = 0.0
    for start in range(0, n, ROWS):
        stop = min(n, start + ROWS)
        part = out[start + 1 : stop + 1]
        live = (first < stop) & (last > start)
        way = np.where(live, start - middle, 0.0)
        part[0] = weight * np.exp(-0.5 * way * way * rate) * live
        factor = np.exp(-(way + 0.5) * rate)
        for k in range(1, stop - start):
            np.multiply(part[k - 1], factor, out=part[k])
            factor *= slower
        for begin, end in ((np.full(m, start), first), (last, np.full(m, stop))):  # cells beyond the cut
            some = np.flatnonzero(live & (begin >= start) & (end <= stop) & (end > begin))
            length = end[some] - begin[some]
            upto = np.cumsum(length)
            part.ravel()[np.arange(length.sum()) * m + np.repeat((begin[some] - start - upto + length) * m + some, length)] = 0.0
        for k in range(start, stop):
            out[k + 1] += out[k]
    return out


def kernel(size: int) -> np.ndarray:
    if size in SHORT_KERNELS:
        return np.array(SHORT_KERNELS[size])
    spread = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    out = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * spread * spread))
    return out / out.sum()


def plateau(lo: np.ndarray, hi: np.ndarray, blur: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Running sums (n + 1 x m) of the intervals' whole cells, blurred by kernels of ``blur`` cells and weighted; what lies beyond an end mirrors what lies before it."""
    first, last = np.clip(np.floor(lo), 0, n).astype(int), np.clip(np.ceil(hi), 0, n).astype(int)
    sizes, which = np.unique(blur, return_inverse=True)
    if n == 1 or not len(sizes) or sizes[-1] // 2 >= n:  # mirrored more than once
        return _upto(_plateau_by_cells(first, last, blur, n) * weight[:, None]).T
    # an interval is a step up and a step down, as are its mirror images beyond either end, which join it without a step where it touches the end; a
    # blurred step rises by one value of the kernel a cell
    kernels, sums = ([f(kernel(int(size))) for size in sizes] for f in (np.asarray, _upto))
    base, reach, most, many = (np.cumsum(sizes) - sizes)[which.reshape(-1)], blur // 2, int(sizes[-1]) // 2, len(first)
    some = (last > first) & (weight != 0)
    left, right = some & (first < most + 1), some & (last > n - most - 1)
    steps = [(some & (first > 0), first, 1), (some & (last < n), last, -1), (left, 1 - last, 1), (left & (first > 0), np.minimum(1 - first, 0), -1), (right & (last < n), 2 * n - 1 - last, 1), (right, 2 * n - 1 - first, -1)]
    rows = [np.flatnonzero(asked & (at - reach < n)) for asked, at, _ in steps]
    start = np.concatenate([at[r] - reach[r] for (_, at, _), r in zip(steps, rows)])
    size = np.concatenate([sign * weight[r] for (*_, sign), r in zip(steps, rows)])
    rows = np.concatenate(rows)
    before = np.clip(-start, 0, blur[rows])  # values before the first cell
    now = np.bincount(rows, size * np.concatenate(sums)[base[rows] + which.reshape(-1)[rows] + before], many)
    length = np.minimum(blur[rows], n - start) - before
    upto = np.cumsum(length) - length
    step = np.repeat(np.arange(len(rows)), length)
    nth = np.arange(len(step))
    value = np.concatenate(kernels)[nth + (base[rows] + before - upto)[step]] * size[step]
    out = np.bincount(nth * many + ((start + before + 1 - upto) * many + rows)[step], value, (n + 1) * many).reshape(-1, many)
    for k in range(n):
        now += out[k + 1]
        np.add(out[k], now, out=out[k + 1])
    return out


def _plateau_by_cells(first: np.ndarray, last: np.ndarray, blur: np.ndarray, n: int) -> np.ndarray:
    cell = np.arange(n)
    flat = ((cell >= first[:, None]) & (cell < last[:, None])).astype(float)
    out = np.empty_like(flat)
    for size in np.unique(blur):
        rows, reach = np.flatnonzero(blur == size), size // 2
        at = np.arange(-reach, n + reach)
        while n > 1 and ((at < 0) | (at >= n)).any():
            at = np.where(at < 0, -at, np.where(at >= n, 2 * (n - 1) - at, at))
        wide = flat[rows][:, np.clip(at, 0, n - 1)]
        out[rows] = sum(k * wide[:, j : j + n] for j, k in enumerate(kernel(int(size))))
    return out


def stretched(size: int, n: int) -> np.ndarray:
    """n x size: how ``n`` cells are read off ``size`` samples, straight lines between the samples' middles."""
    at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
    low = np.minimum(np.floor(at).astype(int), max(size - 2, 0))
    out = np.zeros((n, size))
    out[np.arange(n), low] += 1 - (at - low)
    if size > 1:
        out[np.arange(n), low + 1] += at - low
    return out


def _upto(x: np.ndarray) -> np.ndarray:
    """Running sums along the last axis, from 0."""
    return np.concatenate([np.zeros((*x.shape[:-1], 1)), np.cumsum(x, axis=-1)], axis=-1)


class Maps:
    """The maps of some frames, a layer of heads and one of bodies: running sums of each subject's profiles across and down, cells x frames x subjects."""

    def __init__(self, width: int, height: int, heads: np.ndarray, weight: np.ndarray, bodies: np.ndarray | None = None, body_weight: np.ndarray | None = None, saliency: np.ndarray | None = None, cells: int = CELLS):
        """``heads`` and ``bodies`` are 4 x frames x subjects, weights frames x subjects with 0 where there is none; ``saliency`` is frames x rows x columns."""
        self.across, self.down = shape(width, height, cells)
        self.scale, self.frames = 1.0 / (width / self.across), heads.shape[1]
        x1, y1, x2, y2 = (heads * self.scale).reshape(4, -1)
        solid = ((x2 > x1) & (y2 > y1)).astype(float)
        flat = [(bell(x1, x2, weight.ravel() * solid, self.across), bell(y1, y2, solid, self.down))]
        if bodies is not None and bodies.shape[2]:
            x1, y1, x2, y2 = (bodies * self.scale).reshape(4, -1)
            blur = np.maximum(3, (np.maximum(np.minimum(x2 - x1, y2 - y1), 0) * SOFT).astype(int) | 1)
            filled = ((np.minimum(np.ceil(x2), self.across) > np.maximum(np.floor(x1), 0)) & (np.minimum(np.ceil(y2), self.down) > np.maximum(np.floor(y1), 0))).astype(float)
            flat.append((plateau(x1, x2, blur, body_weight.ravel() * filled, self.across), plateau(y1, y2, blur, filled, self.down)))
        self.layers = [tuple(v.reshape(len(v), self.frames, v.shape[1] // max(1, self.frames)) for v in layer) for layer in flat]
        self.saliency = None if saliency is None else SALIENCY_WEIGHT * saliency
        if saliency is not None:
            self.to_x, self.to_y = (_upto(stretched(size, n).T).T for size, n in ((saliency.shape[2], self.across), (saliency.shape[1], self.down)))
        self.total = sum((x[-1] * y[-1]).sum(axis=1) for x, y in self.layers)
        if saliency is not None:
            self.total = self.total + np.einsum("fji,j,i->f", self.saliency, self.to_y[-1], self.to_x[-1])
        self.known = self.total > 1e-8

    def lanes(self, frame: np.ndarray) -> Lanes:
        return Lanes(self, frame)

    def edges(self, x1, y1, x2, y2) -> tuple[np.ndarray, ...]:
        """The cells where windows begin and end: left, right, above, below."""
        at = lambda v, n: np.clip(np.rint(v * self.scale), 0, n).astype(int)
        left, right, above, below = at(x1, self.across), at(x2, self.across), at(y1, self.down), at(y2, self.down)
        return left, np.maximum(left, right), above, np.maximum(above, below)

    def shares(self, x, y, w, h) -> np.ndarray:
        """What windows hold of all importance, frames x rows x columns: ``x`` spreads over frames and columns, ``y`` over frames and rows."""
        x, y, w, h = (np.moveaxis(np.reshape(v, (1,) * (3 - np.ndim(v)) + np.shape(v)), 0, -1) for v in (x, y, w, h))
        return np.moveaxis(self.lanes(np.arange(self.frames)).shares(x, y, w, h), -1, 0)

    def blocks(self, left, right, above, below, lo: int, hi: int) -> np.ndarray:
        """The shares of frames ``lo`` to ``hi`` between edges, sizes x rows x columns x frames: ``left`` and ``right`` are sizes x columns, ``above`` and ``below`` sizes x rows. Single precision."""
        known = self.known[lo:hi]
        total = np.where(known, self.total[lo:hi], 1.0)
        out = np.zeros((*above.shape, left.shape[1], len(known)), np.float32)
        for x, y in self.layers:
            across = np.ascontiguousarray(np.moveaxis(x[right, lo:hi] - x[left, lo:hi], 3, 0) / total, dtype=np.float32)  # subjects x sizes x columns x frames
            down = np.ascontiguousarray(np.moveaxis(y[below, lo:hi] - y[above, lo:hi], 3, 0), dtype=np.float32)
            for a, d in zip(across, down):
                out += a[:, None] * d[:, :, None]
        if self.saliency is not None:
            x, y = self.to_x[right] - self.to_x[left], self.to_y[below] - self.to_y[above]
            out += (np.einsum("srj,fji,sci->srcf", y, self.saliency[lo:hi], x, optimize=True) / total).astype(np.float32)
        if not known.all():
            flat = ((right - left)[:, None] * (below - above)[:, :, None] / (self.across * self.down))[..., None]
            out = np.where(known, out, flat.astype(np.float32))
        return out


class Lanes:
    """Windows by the lane, each lane of the frame that ``frame`` names: what ``Maps.shares`` says of them, without a copy of the sums for each."""

    def __init__(self, maps: Maps, frame: np.ndarray):
        self.maps, self.frame = maps, frame

    def lanes(self, frame: np.ndarray) -> Lanes:
        return Lanes(self.maps, self.frame[frame])

    def shares(self, x, y, w, h) -> np.ndarray:
        """Shares, rows x columns x lanes, of windows at ``x``, 1 x columns x lanes, and ``y``, rows x 1 x lanes; a lane may stand for all."""
        left, right, above, below = self.maps.edges(x, y, x + w, y + h)
        return self.between(left[0], right[0], above[:, 0], below[:, 0])

    def between(self, left, right, above, below) -> np.ndarray:
        """Shares, rows x columns x lanes, between edges: ``left`` and ``right`` are columns x lanes, ``above`` and ``below`` rows x lanes."""
        maps, frame = self.maps, self.frame
        held = np.zeros((len(above), len(left), len(frame)))
        for sums in maps.layers:
            across, down = (v.reshape(v.shape[0] * v.shape[1], v.shape[2]) for v in sums)
            at = lambda v, edge: v.take(edge * maps.frames + frame, axis=0)
            across, down = at(across, right) - at(across, left), at(down, below) - at(down, above)
            for k in range(across.shape[2]):
                held += across[..., k] * down[:, None, :, k]
        if maps.saliency is not None:
            for lo in range(0, len(frame), 256):
                cut = lambda v: v[:, lo : lo + 256] if v.shape[1] > 1 else v  # noqa: B023, E731
                across, down = maps.to_x[cut(right)] - maps.to_x[cut(left)], maps.to_y[cut(below)] - maps.to_y[cut(above)]  # places x lanes x samples
                found = np.matmul(np.matmul(down.transpose(1, 0, 2), maps.saliency[frame[lo : lo + 256]]), across.transpose(1, 2, 0))
                held[..., lo : lo + 256] += np.moveaxis(found, 0, -1)
        known = maps.known[frame]
        held /= np.where(known, maps.total[frame], 1.0)
        if not known.all():  # all cells alike where nothing was found
            held = np.where(known, held, (right - left) * (below - above)[:, None] / (maps.across * maps.down))
        return held


def padded(lists: pa.Array, parts: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(parts x frames x most subjects, number per frame) of a column of lists of structs; 0 where a frame has fewer."""
    number = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    frame = np.repeat(np.arange(len(number)), number)
    nth = np.arange(len(frame)) - np.repeat(np.cumsum(number) - number, number)
    out, flat = np.zeros((len(parts), len(number), number.max(initial=0))), lists.flatten()
    for i, c in enumerate(parts):
        out[i, frame, nth] = flat.field(c).to_numpy(zero_copy_only=False)
    return out, number


def heads_of(box: np.ndarray) -> np.ndarray:
    """Head boxes of face boxes, sides in front; not cut at the frame."""
    left, above, right, below = boxes.HEAD_PAD
    side = np.maximum(box[2:] - box[:2], 0.0)
    return np.concatenate([box[:2] - np.stack([left * side[0], above * side[1]]), box[2:] + np.stack([right * side[0], below * side[1]])])


def box_shares(crops: DataFrame, faces: DataFrame, width: int, height: int, by: str = "frame_id", bodies: DataFrame | None = None, boost: str | None = None, cells: int = CELLS) -> DataFrame:
    """``crops`` (by, crop_no, x1, y1, x2, y2 in frame pixels) plus ``held``: the share of the frame's importance inside.

    ``faces`` and ``bodies`` have by, x1, y1, x2, y2, conf; ``boost`` names a column of faces that multiplies their weight. A frame without subjects counts all cells alike. One
    shuffle on the frame: its subjects and windows form arrays.
    """
    sides = ("x1", "y1", "x2", "y2")
    value = lambda c: F.col(c).cast("double").alias(c)
    face = F.struct(*[value(c) for c in (*sides, "conf")], (F.col(boost) if boost else F.lit(1.0)).cast("double").alias("boost"))
    kinds = [crops.select(by, F.struct(F.col("crop_no").cast("long").alias("crop_no"), *[value(c) for c in sides]).alias("crop")), faces.select(by, face.alias("face"))]
    if bodies is not None:
        kinds.append(bodies.select(by, F.struct(*[value(c) for c in (*sides, "conf")]).alias("body")))
    both = kinds[0]
    for kind in kinds[1:]:
        both = both.unionByName(kind, allowMissingColumns=True)
    names = [c for c in both.columns if c != by]
    held = both.groupBy(by).agg(*[F.array_sort(F.collect_list(c)).alias(c) for c in names]).filter(F.size("crop") > 0)

    embodied = bodies is not None

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found, _ = padded(part.column("face"), (*sides, "conf", "boost"))
                number = part.column("face").value_lengths().to_numpy(zero_copy_only=False)
                there = np.arange(found.shape[2]) < number[:, None]
                area = np.maximum(found[2] - found[0], 0) * np.maximum(found[3] - found[1], 0)
                weight = face_weights(area, area.max(axis=1, initial=0.0, keepdims=True), found[4]) * found[5] * there
                body = padded(part.column("body"), (*sides, "conf"))[0] if embodied else None
                some = None if body is None else body_weights(body[4]) * (np.arange(body.shape[2]) < part.column("body").value_lengths().to_numpy(zero_copy_only=False)[:, None])
                maps = Maps(width, height, heads_of(found[:4]), weight, None if body is None else body[:4], some, cells=cells)
                asked, many = padded(part.column("crop"), (*sides, "crop_no"))
                out = np.stack([maps.shares(*(v.reshape(-1, 1, 1) for v in (x1, y1, x2 - x1, y2 - y1)))[:, 0, 0] for x1, y1, x2, y2 in asked[:4].transpose(2, 0, 1)], axis=1)
                kept = np.arange(asked.shape[2]) < many[:, None]
                columns = [part.column(by).take(pa.array(np.nonzero(kept)[0])), pa.array(asked[4][kept].astype(np.int64)), *[pa.array(v[kept]) for v in asked[:4]], pa.array(out[kept])]
                yield pa.RecordBatch.from_arrays(columns, names=[by, "crop_no", *sides, "held"])

    ship(crops.sparkSession)
    return held.mapInArrow(run, T.StructType([crops.schema[by], T.StructField("crop_no", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in (*sides, "held")]]))
