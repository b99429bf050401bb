"""Crop search: a grid of windows of each size, refined round the best place of the size. Frames are scored in Arrow batches by NumPy, so that
thousands of windows a frame never become rows."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gatelight.functions import boxes
from gatelight.operators import maps
from gatelight.workers import ship

INTACT, GONE = 0.995, 0.02
DROP_PENALTY, CLIP_PENALTY = 0.22, 3.0
SAFE_PENALTY, RESERVED_PENALTY = 0.9, 1.1
SMALL_FACE = 0.75  # what is left of the composition where the tallest face is under the profile's least height
NO_SUBJECT = 0.5  # composition of a frame without faces and bodies
LEAST_KEPT = 0.6  # of the primary face, for any composition
ANCHOR, ANCHOR_SIZE = 0.55, 0.6
W_COVERAGE, W_COMPOSITION, W_SCALE = 1.0, 0.55, 0.22
PART, SUBJECTS = 1024, 12288  # frames, and subjects of them, whose profiles are held at a time
CHUNK = 64  # frames whose grids are bounded at a time: their arrays stay in the cache
BLOCK = 4  # places a side of the blocks that grids are bounded by
LANES = 1024  # blocks of windows scored at a time
SLACK = 2e-4  # what a bound in single precision may be wrong by, many times over
STEEP, HEAVY = 1e4, 8.0  # how fast a bound lets go beyond a limit, and the most that it counts a face in zones: so it stays right in single precision


class Rules(NamedTuple):
    """What a profile asks of a crop; zones are (x1, y1, x2, y2) in shares of the window."""

    centre: bool = False
    headroom: bool = True
    action: tuple[float, float, float, float] | None = None
    reserved: tuple[tuple[float, float, float, float], ...] = ()
    least_face: float = 0.0


def sizes(width: int, height: int, aspect: float, min_scale: float, scales: int) -> list[tuple[int, int]]:
    """Window sizes from the largest that fits down to ``min_scale`` of it, none twice."""
    wide = width / height > aspect
    big_w = max(1, math.floor(height * aspect if wide else width))
    big_h = max(1, math.floor(height if wide else width / aspect))
    scaled = (1 - (1 - min_scale) * i / max(1, scales - 1) for i in range(scales))
    return list(dict.fromkeys((min(width, max(16, round(big_w * s))), min(height, max(16, round(big_h * s)))) for s in scaled))


def places(span: int, steps: int) -> np.ndarray:
    return np.linspace(0, span, min(steps, max(2, span + 1))) if span > 0 else np.zeros(1)


def _placing(primary, w, h, x, y, rules: Rules):
    """What composition gives for the primary face's place across and down the window; they add up to 1 at most."""
    x1, y1, x2, y2 = primary[:4]
    rx = ((x1 + x2) / 2 - x) / w
    if rules.centre:
        side = np.maximum(0.0, 1 - np.abs(rx - 0.5) / 0.35)
    else:
        side = np.maximum(0.0, 1 - np.minimum(np.minimum(np.abs(rx - 1 / 3), np.abs(rx - 2 / 3)), np.abs(rx - 0.5) * 1.15) / 0.30)
    eye = (y1 + np.maximum(y2 - y1, 0) * 0.42 - y) / h
    line = np.maximum(0.0, 1 - np.abs(eye - (0.36 if rules.headroom else 0.5)) / 0.30)
    room = (y1 - y) / h
    air = np.clip(np.minimum(room / 0.04, 1 - (room - 0.20) / 0.28), 0.0, 1.0) if rules.headroom else 1.0
    return 0.40 * side, 0.34 * line + 0.26 * air


def _composition(primary, w, h, x, y, kept, rules: Rules):
    """0 to 1: thirds, eye line and headroom of the primary face; 0 if the crop holds under .6 of it."""
    across, down = _placing(primary, w, h, x, y, rules)
    return np.minimum(1.0, across + down) * (kept >= LEAST_KEPT)


def _best_placing(primary, w, h, x, y, rules: Rules):
    """The most that ``_placing`` gives anywhere between the first and last of ``x`` and of ``y``."""
    x1, y1, x2, y2 = primary[:4]
    middle, eye = (x1 + x2) / 2, y1 + np.maximum(y2 - y1, 0) * 0.42
    off = lambda at: np.maximum(0.0, np.maximum(at - (middle - x[0]) / w, (middle - x[1]) / w - at))
    near = lambda at, v: np.minimum(np.maximum(at, (v - y[1]) / h), (v - y[0]) / h)
    side = np.maximum(0.0, 1 - (off(0.5) / 0.35 if rules.centre else np.minimum(np.minimum(off(1 / 3), off(2 / 3)), off(0.5) * 1.15) / 0.30))
    level = 0.36 if rules.headroom else 0.5
    line = np.maximum(0.0, 1 - np.abs(near(level, eye) - level) / 0.30)
    room = near(0.12, y1)
    air = np.clip(np.minimum(room / 0.04, 1 - (room - 0.20) / 0.28), 0.0, 1.0) if rules.headroom else 1.0
    return 0.40 * side, 0.34 * line + 0.26 * air


def _edges(x, y, w, h, zone=(0.0, 0.0, 1.0, 1.0)):
    """Sides of windows, or of a zone of theirs."""
    return x + w * zone[0], y + h * zone[1], x + w * zone[2], y + h * zone[3]


def _overlaps(b, left, above, right, below):
    """How far boxes reach into windows, across in shares of the box's area and down; their product is the share held."""
    ax, ay, bx, by = b[:4]
    across = np.maximum(np.minimum(bx, right) - np.maximum(ax, left), 0)
    down = np.maximum(np.minimum(by, below) - np.maximum(ay, above), 0)
    return across * b[4], down


def _with_area(b: np.ndarray) -> np.ndarray:
    """Boxes with a fifth row: one by their area, 0 without one."""
    area = np.maximum(b[2] - b[0], 0) * np.maximum(b[3] - b[1], 0)
    return np.concatenate([b, np.where(area > 0, 1 / np.where(area > 0, area, 1.0), 0.0)[None]])


class Frames:
    """The faces of some frames, those with most faces first: arrays of face number x frame, boxes with their sides in front."""

    def __init__(
        self, box: np.ndarray, conf: np.ndarray, number: np.ndarray, width: int, height: int, boost: np.ndarray | float = 1.0, anchor: np.ndarray | None = None,
        bodies: tuple[np.ndarray, np.ndarray] | None = None, saliency: np.ndarray | None = None,
    ):
        """``box`` is 4 x faces x frames x 1 x 1, ``conf`` and ``boost`` faces x frames x 1 x 1; ``number`` has the faces of each frame.

        ``anchor`` is 4 x frames x 1 x 1: centre and width of the window that each frame's is drawn to, and how strongly. ``bodies``: boxes, 4 x frames x
        bodies, and weights, frames x bodies (0: none). ``saliency``: frames x rows x columns.
        """
        box, conf, boost, anchor = (v[..., 0, 0] if np.ndim(v) else v for v in (box, conf, boost, anchor))
        side = np.maximum(box[2:] - box[:2], 0.0)
        area = side[0] * side[1]
        self.frame, self.number, self.anchor = (width, height), number, anchor
        there = np.arange(len(conf))[:, None] < number
        top = np.where(there, area, 0.0).max(axis=0, keepdims=True)  # a face counts beside the largest of its frame
        self.weight = maps.face_weights(area, top, conf) * boost
        head = maps.heads_of(box)
        every = np.arange(len(number))
        self.maps = maps.Maps(width, height, head.swapaxes(1, 2), (self.weight * there).T, *(bodies or (None, None)), saliency).lanes(every)
        cut = side * (-boxes.CORE_SHRINK / 2)
        limit = np.array([width, height], dtype=float).reshape(2, 1, 1)
        self.core = np.concatenate([np.maximum(box[:2] + cut, 0.0), np.minimum(box[2:] - cut, limit)])
        head = np.concatenate([np.maximum(head[:2], 0.0), np.minimum(head[2:], limit)])
        room = np.maximum(head[2:] - head[:2], 0.0)
        rank = np.where(there, self.weight * room[0] * room[1], -1.0)
        first, tallest = np.argmax(rank, axis=0), np.argmax(np.where(there, room[1], -1.0), axis=0)
        self.subject, self.primary = number > 0, head[:, first, every]  # what composition goes by: the largest subject by weight
        odd = (self.weight * there < 0).any(axis=0)
        if bodies is not None and bodies[1].shape[1]:
            at, weight = bodies
            rank_b = np.where(weight > 0, weight * np.maximum(at[2] - at[0], 0) * np.maximum(at[3] - at[1], 0), -1.0)
            best = np.argmax(rank_b, axis=1)
            wins = rank_b[every, best] >= rank[first, every]
            self.primary = np.where(wins & (weight[every, best] > 0), at[:, every, best], self.primary)
            self.subject = self.subject | (weight > 0).any(axis=1)
            odd |= (weight < 0).any(axis=1)
        if saliency is not None:
            odd |= (saliency < 0).any(axis=(1, 2))
        self.odd = odd | (anchor[3] < 0) if anchor is not None else odd  # a subject that counts against its frame, or a window pushed away: no bound
        self.core, self.tall, self.primary = _with_area(self.core), _with_area(head[:, tallest, every]), _with_area(self.primary)

    def take(self, frame: np.ndarray) -> Frames:
        """Frames by number, each as often as it is named; numbers must not fall."""
        out = object.__new__(Frames)
        most = max(1, self.number[frame].max(initial=0))
        out.frame, out.number, out.subject, out.odd, out.maps = self.frame, self.number[frame], self.subject[frame], self.odd[frame], self.maps.lanes(frame)
        out.primary, out.tall, out.core, out.weight = (v.take(frame, axis=-1) for v in (self.primary, self.tall, self.core[:, :most], self.weight[:most]))
        out.anchor = None if self.anchor is None else self.anchor[:, frame]
        return out

    def score(self, w, h, x: np.ndarray, y: np.ndarray, biggest: float, rules: Rules, alone: bool = False):
        """Score to 6 places, intact, clipped and dropped faces of the windows at ``x``, frames x 1 x columns, and ``y``, frames x rows x 1; one may stand for all frames.

        With ``alone`` faces are not counted.
        """
        w, h, x, y = (np.moveaxis(v, 0, -1) if np.ndim(v) else v for v in (w, h, x, y))  # frames behind: one pass over all windows of a place
        shape = (len(y), x.shape[1], len(self.number))

        def held(b, edges, cut=slice(None)):
            across, down = _overlaps(b, *(v[..., cut] if np.ndim(v) and v.shape[-1] > 1 else v for v in edges))
            return across * down

        loss = np.zeros(shape)
        intact, dropped = np.zeros((2, *((1, 1, 1) if alone else shape)), dtype=np.int32)
        whole, action, *reserved = (_edges(x, y, w, h, zone) for zone in ((0.0, 0.0, 1.0, 1.0), rules.action or (0.0, 0.0, 1.0, 1.0), *rules.reserved))
        for k in range(self.weight.shape[0]):
            cut = slice(0, int((self.number > k).sum()))
            core, weight = self.core[:, k, cut], self.weight[k, cut]
            f, least = held(core, whole, cut), np.minimum(1.0, weight)
            kept, gone = f >= INTACT, f <= GONE
            lost = (1 - f) * (CLIP_PENALTY * least)
            lost *= ~(kept | gone)
            lost += DROP_PENALTY * least * gone
            if not alone:
                intact[..., cut] += kept
                dropped[..., cut] += gone
            inside = f >= 0.5
            if rules.action:
                safe = held(core, action, cut)
                lost += (1 - safe) * (SAFE_PENALTY / 2 * weight) * (inside & (safe < 0.98))
            for zone in reserved:
                under = held(core, zone, cut)
                lost += under * (RESERVED_PENALTY / 2 * weight) * (inside & (under > 0.02))
            loss[..., cut] += lost
        composed = _composition(self.primary, w, h, x, y, held(self.primary, whole), rules)
        composed[..., ~self.subject] = NO_SUBJECT
        if rules.least_face:
            small = (self.tall[3] - self.tall[1]) / h < rules.least_face
            if small.any():
                composed = np.where((held(self.tall, whole) > 0.5) & small, composed * SMALL_FACE, composed)
        score = W_COVERAGE * self.maps.shares(x, y, w, h) + W_COMPOSITION * composed + W_SCALE * np.sqrt(w * h / biggest) - loss
        if self.anchor is not None:
            (at_x, at_y, wide, strength), (width, height) = self.anchor, self.frame
            way = np.hypot((x + w / 2 - at_x) / width, (y + h / 2 - at_y) / height)
            score = score - strength * (way + ANCHOR_SIZE * np.abs(w - wide) / width)
        return tuple(np.moveaxis(v, -1, 0) for v in (np.round(score, 6), intact, self.number - intact - dropped, dropped))

    def _lanes(self, frame: np.ndarray, w, h, x, y, biggest: float, rules: Rules) -> np.ndarray:
        """Scores, rows x columns x lanes, of windows at ``x``, columns x lanes, and ``y``, rows x lanes, of frames in order."""
        out = np.empty((len(y), len(x), len(frame)))
        for lo in range(0, len(frame), LANES):
            cut = slice(lo, lo + LANES)
            out[..., cut] = np.moveaxis(self.take(frame[cut]).score(w[cut, None, None], h[cut, None, None], x[:, cut].T[:, None], y[:, cut].T[..., None], biggest, rules, True)[0], 0, -1)
        return out

    def _most(self, w, h, x, y, share: np.ndarray, biggest: float, rules: Rules) -> np.ndarray:
        """What windows can score at most, give or take ``SLACK``, where they lie anywhere between two places, the first and last of ``x`` and of ``y``. Single precision.

        ``x`` is 2 x ... columns x frames, ``y`` 2 x ... rows x frames; the result, as ``share``, ... rows x columns x frames. What such windows hold of a subject is at
        most what the window from the first's left to the last's right side holds, which gives ``share``; places that they give to a subject are bounded across and
        down by themselves. Limits are let go of steeply, not at once: no branch is taken, and a bound stays one.
        """
        single = np.float32
        across, down = (lambda v: v.astype(single)[..., None, :, :]), (lambda v: v.astype(single)[..., :, None, :])

        def sides(zone=(0.0, 0.0, 1.0, 1.0)):
            """Of all windows together and of what they have in common: the first's left and upper sides with the last's others, and the last's with the first's."""
            first, last = (_edges(x[k], y[k], w, h, zone) for k in (0, 1))
            return first[:2] + last[2:], last[:2] + first[2:]

        def reach(b, edges, scale=1.0):
            """The share of boxes between edges, times ``scale``: as a column and a row."""
            held = _overlaps(b, *edges)
            return across(held[0] * scale), down(held[1])

        def beyond(most, held, limit):
            """What is lacking of ``most``, where less than ``limit`` of it is held."""
            out = (most * (limit - 1e-4)).astype(single) - held
            np.maximum(out, 0, out=out)
            out *= single(STEEP)
            return np.minimum(out, most.astype(single) - held, out=out)

        (any_, all_), reserved = sides(), [sides(zone)[1] for zone in rules.reserved]
        action = sides(rules.action)[0] if rules.action else None
        bound = share.astype(single)
        side, rest = _best_placing(self.primary, w, h, x, y, rules)
        composed = across(W_COMPOSITION * side) + down(W_COMPOSITION * rest)
        a, d = reach(self.primary, any_, STEEP)
        np.minimum(composed, np.maximum(a * d - single(STEEP * (LEAST_KEPT - 1e-4)), 0), out=composed)
        composed[..., ~self.subject] = W_COMPOSITION * NO_SUBJECT
        small = (self.tall[3] - self.tall[1]) / h < rules.least_face
        if small.any():
            a, d = reach(self.tall, all_)
            composed *= 1 - (1 - SMALL_FACE) * ((a * d > 0.5 + 1e-5) & small[..., None, :, :]).astype(single)
        bound += composed
        for k in range(self.core.shape[1]):
            heavy = np.where(self.number > k, np.minimum(self.weight[k], HEAVY), 0.0)
            box, least = self.core[:, k], np.minimum(1.0, heavy)
            (a, d), (a_, d_) = reach(box, any_, CLIP_PENALTY * least), reach(box, all_, STEEP)
            sure = a_ * d_  # what all of the windows hold
            lost = beyond(CLIP_PENALTY * least, a * d, INTACT)
            kept = sure - single(STEEP * (GONE + 1e-4))
            np.maximum(kept, 0, out=kept)
            kept += (DROP_PENALTY * least).astype(single)
            bound -= np.minimum(lost, kept, out=lost)
            if rules.action or rules.reserved:
                inside = np.maximum(sure - single(STEEP * (0.5 + 1e-4)), 0, out=sure)
            if rules.action:
                a, d = reach(box, action, SAFE_PENALTY / 2 * heavy)
                outside = beyond(SAFE_PENALTY / 2 * heavy, a * d, 0.98)
                bound -= np.minimum(outside, inside, out=outside)
            for zone in reserved:
                a, d = reach(box, zone, RESERVED_PENALTY / 2 * heavy)
                under = a * d - (0.02 * RESERVED_PENALTY / 2 * heavy).astype(single)
                np.maximum(under, 0, out=under)
                bound -= np.minimum(under, inside, out=under)
        if self.anchor is not None:
            (at_x, at_y, wide, strength), (width, height) = self.anchor, self.frame
            off_x, off_y = (np.maximum(0.0, np.maximum(v[0] + s / 2 - p, p - v[1] - s / 2)) for v, s, p in ((x, w, at_x), (y, h, at_y)))
            bound -= np.hypot(across(strength * off_x / width), down(strength * off_y / height))
            bound -= across(strength * ANCHOR_SIZE * np.abs(w - wide) / width)
        bound += across((w * h / biggest) ** 0.5 * W_SCALE)
        bound[..., self.odd] = np.inf
        return bound

    def _bounds(self, windows: list[tuple[int, int]], places_of: list[tuple[np.ndarray, np.ndarray]], biggest: float, rules: Rules) -> np.ndarray:
        """Bounds of all windows in blocks of ``BLOCK`` places a side, frames x sizes x rows x columns: a block is all that lies from its first place to the next block's first."""
        w, h = np.array(windows, dtype=float).T[:, :, None, None]
        starts = [np.arange(max(-(-len(p[axis]) // BLOCK) for p in places_of)) * BLOCK for axis in (0, 1)]
        x, y = (np.array([[c[np.minimum(start + step, len(c) - 1)] for c in (p[axis] for p in places_of)] for step in (0, BLOCK)])[..., None] for axis, start in enumerate(starts))
        edges = [v[..., 0] for v in self.maps.maps.edges(x[0], y[0], x[1] + w, y[1] + h)]
        out = np.empty((len(self.number), len(windows), len(starts[1]), len(starts[0])), np.float32)
        for lo in range(0, len(out), CHUNK):
            some = np.arange(lo, min(len(out), lo + CHUNK))
            out[some] = np.moveaxis(self.take(some)._most(w, h, x, y, self.maps.maps.blocks(*edges, lo, lo + len(some)), biggest, rules), 3, 0)
        for s, (xs, ys) in enumerate(places_of):  # sizes with fewer places
            out[:, s, starts[1] >= len(ys)] = -np.inf
            out[:, s, :, starts[0] >= len(xs)] = -np.inf
        return out

    def grids(self, windows: list[tuple[int, int]], places_of: list[tuple[np.ndarray, np.ndarray]], biggest: float, rules: Rules, winners: bool = False) -> np.ndarray:
        """Score, x and y of each frame's best window of each size's grid, 3 x frames x sizes; of equal scores the first, row by row.

        Blocks of windows are bounded from above; the block with the highest bound is scored, and then those whose bound is no less than the best score
        found. What is left out scores less, so the result is that of scoring all. With ``winners``, sizes that cannot have the frame's best window, neither on the
        grid nor between its places, are left out: their score is -inf.
        """
        n, many = len(self.number), len(windows)
        bound = self._bounds(windows, places_of, biggest, rules)
        columns, bound = bound.shape[3], bound.reshape(n * many, -1)
        wide, high = (np.array(side, dtype=float) for side in zip(*windows))
        number = np.array([[len(v) for v in p] for p in places_of]).T
        at_x, at_y = (np.array([np.pad(p[axis], (0, number[axis].max() - len(p[axis]))) for p in places_of]) for axis in (0, 1))
        side = np.arange(BLOCK)[:, None]
        tried = []

        def score(lane, block):
            """The best windows of blocks, each of a frame and size: their scores; of equal ones the first."""
            s = lane % many
            i, j = np.minimum(block % columns * BLOCK + side, number[0, s] - 1), np.minimum(block // columns * BLOCK + side, number[1, s] - 1)
            x, y = at_x[s, i], at_y[s, j]
            found = self._lanes(lane // many, wide[s], high[s], x, y, biggest, rules).reshape(BLOCK * BLOCK, -1)
            every, at = np.arange(len(lane)), found.argmax(axis=0)
            row, column, found = at // BLOCK, at % BLOCK, found[at, every]
            tried.append((lane, j[row, every] * number[0, s] + i[column, every], found, x[column, every], y[row, every]))
            return found

        def closer(lane, block):
            """Blocks bounded anew, from place to place: the highest of each."""
            s = lane % many
            i, j = (np.minimum(at * BLOCK + np.arange(BLOCK + 1)[:, None], number[axis, s] - 1) for axis, at in enumerate((block % columns, block // columns)))
            x, y, w, h = at_x[s, i], at_y[s, j], wide[s][None], high[s][None]
            out = np.empty(len(lane), np.float32)
            for lo in range(0, len(lane), LANES):
                cut = slice(lo, lo + LANES)
                part, a, d, w_, h_ = self.take(lane[cut] // many), x[:, cut], y[:, cut], w[:, cut], h[:, cut]
                share = part.maps.between(*part.maps.maps.edges(a[:-1], d[:-1], a[1:] + w_, d[1:] + h_))
                out[cut] = part._most(w_, h_, (a[:-1], a[1:]), (d[:-1], d[1:]), share, biggest, rules).max(axis=(0, 1))
            return out

        most, first = bound.max(axis=1), bound.argmax(axis=1)
        least = np.full(n * many, -np.inf)
        floor = lambda: least.reshape(n, many).max(axis=1, keepdims=True) - SLACK
        under = lambda values, limit: values < np.asarray(limit).astype(np.float32)

        def finish(lanes):
            """The best windows of frames and sizes: the likeliest block, then those that may hold as good ones."""
            if not len(lanes):
                return
            least[lanes] = score(lanes, first[lanes])
            open_ = ~under(bound[lanes], least[lanes][:, None] - SLACK)
            open_[np.arange(len(lanes)), first[lanes]] = False
            row, block = np.nonzero(open_)
            if len(row):
                np.maximum.at(least, lanes[row], score(lanes[row], block))

        if winners:
            likely = np.arange(n) * many + most.reshape(n, many).argmax(axis=1)
            finish(likely)
            limit = np.repeat(floor(), many, axis=1).ravel()
            rest = ~under(most, limit)
            rest[likely] = False
            rest = np.flatnonzero(rest)
            row, block = np.nonzero(~under(bound[rest], limit[rest][:, None]))
            if len(row):
                np.maximum.reduceat(closer(rest[row], block), np.flatnonzero(np.diff(row, prepend=-1)), out=(again := np.empty(len(rest), np.float32)))
                finish(rest[~under(again, limit[rest])])
        else:
            finish(np.arange(n * many))
        lane, at, found, x, y = (np.concatenate(v) for v in zip(*tried))
        order = np.lexsort((at, -found, lane))
        order = order[np.flatnonzero(np.diff(lane[order], prepend=-1))]
        best = np.full((3, n * many), 0.0)
        best[0] = -np.inf
        best[:, lane[order]] = found[order], x[order], y[order]
        if winners:
            best[0, under(most.reshape(n, many), best[0].reshape(n, many).max(axis=1, keepdims=True) - SLACK).ravel()] = -np.inf
        return best.reshape(3, n, many)

    def search(self, windows: list[tuple[int, int]], biggest: float, steps: int, rounds: int, rules: Rules):
        """x, y, w, h, score, intact, clipped and dropped of the best window of each frame; of equal scores the first tried stays."""
        n, (width, height), many = len(self.number), self.frame, len(windows)
        span = np.array([(width - w, height - h) for w, h in windows], dtype=float).T
        grid = [(places(width - w, steps), places(height - h, steps)) for w, h in windows]
        step = np.array([[d / (len(c) - 1) if len(c) > 1 else 0.0 for d, c in zip(span[:, s], grid[s])] for s in range(many)]).T
        wide, high = (np.array(side, dtype=float) for side in zip(*windows))
        best = self.grids(windows, grid, biggest, rules, winners=True).reshape(3, -1)
        # the sizes left of all frames go through the rounds together
        lanes = np.flatnonzero(best[0] != -np.inf)
        frame, s, here = lanes // many, lanes % many, best[:, lanes]
        (span_x, span_y), (step_x, step_y) = span[:, s], step[:, s]
        moves, nine = np.array([[-1.0], [0.0], [1.0]]), np.arange(9)[:, None]
        going = np.ones(len(lanes), dtype=bool)
        for _ in range(rounds):
            step_x, step_y = step_x / 2, step_y / 2
            better, nth, todo = np.zeros(len(lanes), dtype=bool), np.zeros(len(lanes), dtype=int), np.flatnonzero(going)
            while len(todo):  # all neighbours at once, column by column; where one is better, those after it again, from there
                x, y = np.clip(here[1, todo] + moves * step_x[todo], 0, span_x[todo]), np.clip(here[2, todo] + moves * step_y[todo], 0, span_y[todo])
                score = self._lanes(frame[todo], wide[s[todo]], high[s[todo]], x, y, biggest, rules).swapaxes(0, 1).reshape(9, -1)
                won = (score > here[0, todo]) & (nine >= nth[todo]) & (nine != 4)
                some = np.flatnonzero(won.any(axis=0))
                k, todo = won[:, some].argmax(axis=0), todo[some]
                here[:, todo] = score[k, some], x[k // 3, some], y[k % 3, some]
                better[todo], nth[todo] = True, k + 1
                todo = todo[k < 8]
            going &= better | (step_x >= 0.5) | (step_y >= 0.5)
        best[:, lanes] = here
        every, at = np.arange(n), best[0].reshape(n, many).argmax(axis=1)
        x, y = (v.reshape(n, many)[every, at] for v in best[1:])
        column = lambda v: v.reshape(-1, 1, 1)
        return x, y, wide[at], high[at], *(v.ravel() for v in self.score(column(wide[at]), column(high[at]), column(x), column(y), biggest, rules))


def _dealt(df: DataFrame, key: str) -> DataFrame:
    # rows are few bytes for the work a search is, so that partitions merged by bytes would leave cores idle: the number stays as set
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def solve(faces: DataFrame, width: int, height: int, aspect: float, by: str = "frame_id", min_scale: float = 0.70, scales: int = 4, steps: int = 9, rounds: int = 3, rules: Rules = Rules(), bodies: DataFrame | Column | None = None, saliency: DataFrame | None = None, boost: Column | None = None) -> DataFrame:
    """Best crop per frame: x, y, w, h, score (6 places) and how many faces are intact, clipped and dropped.

    Each size is tried on a grid of ``steps`` places a side, then in ``rounds`` rounds on the eight neighbours of its best place, which moves as
    soon as one is better; the step halves each round. Coverage is the share of the frame's importance (``maps``) inside the window: a Gaussian over each head,
    by area beside the largest, confidence and ``boost`` (who speaks counts more), a plateau over each of ``bodies`` (by, x1, y1, x2, y2, conf; or a column of ``faces``, a struct of the last five for the body of each, which saves a shuffle and a join) and ``saliency`` (by, rows: arrays of 0 to 1, of one shape for all
    frames). Composition goes by the primary subject, the largest by weight and area. Frames are those with a face; subjects of a frame form arrays. One shuffle for each input.
    """
    windows = sizes(width, height, aspect, min_scale, scales)
    biggest = float(math.prod(windows[0]))
    sides = ("x1", "y1", "x2", "y2")
    value = lambda c: F.col(c).cast("double").alias(c)
    face = F.struct("face_no", *[value(c) for c in (*sides, "conf")], (F.lit(1.0) if boost is None else boost).cast("double").alias("boost"))
    gathered = lambda c, name: F.sort_array(F.collect_list(c)).alias(name)
    own = [gathered(F.struct(*[bodies[c].cast("double").alias(c) for c in (*sides, "conf")]), "bodies")] if isinstance(bodies, Column) else []
    held = _dealt(faces, by).groupBy(by).agg(gathered(face, "faces"), *own)
    if bodies is not None and not own:
        held = held.join(bodies.groupBy(by).agg(gathered(F.struct(*[value(c) for c in (*sides, "conf")]), "bodies")), by, "left")
    if saliency is not None:
        held = held.join(saliency.select(by, F.col("rows").cast("array<array<double>>").alias("saliency")), by)

    embodied, salient = bodies is not None, saliency is not None

    def run(batches):
        for batch in batches:
            # frames of as many faces lie together, so that few arrays are padded
            lengths = [batch.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in ("faces", *(["bodies"] if embodied else []))]
            batch = batch.take(pa.array(np.lexsort([-v for v in reversed(lengths)])))
            subjects, lo = sum(lengths)[np.lexsort([-v for v in reversed(lengths)])], 0
            while lo < batch.num_rows:
                part = batch.slice(lo, max(1, min(PART, SUBJECTS // max(1, subjects[lo : lo + PART].max()))))
                lo += part.num_rows
                found, number = maps.padded(part.column("faces"), (*sides, "conf", "boost"))
                found = found.transpose(0, 2, 1)[..., None, None]
                others = None
                if embodied:
                    other, many = maps.padded(part.column("bodies"), (*sides, "conf"))
                    others = other[:4], maps.body_weights(other[4]) * (np.arange(other.shape[2]) < many[:, None])
                seen = np.array(part.column("saliency").to_pylist(), dtype=float) if salient else None
                best = Frames(found[:4], found[4], number, width, height, found[5], None, others, seen).search(windows, biggest, steps, rounds, rules)
                columns = [pa.array(v, kind) for v, kind in zip(best, (pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(by), *columns], names=[by, "x", "y", "w", "h", "score", "intact", "clipped", "dropped"])

    kinds = dict(x=T.DoubleType(), y=T.DoubleType(), w=T.IntegerType(), h=T.IntegerType(), score=T.DoubleType(), intact=T.IntegerType(), clipped=T.IntegerType(), dropped=T.IntegerType())
    ship(faces.sparkSession)
    return held.mapInArrow(run, T.StructType([faces.schema[by], *[T.StructField(c, k) for c, k in kinds.items()]]))


class _Clips:
    """Steps and faces of some clips, flat, with the steps in order of clip and number and the faces in order of step and face number."""

    def __init__(self, clip: np.ndarray, step: np.ndarray, shot: np.ndarray, face: np.ndarray, is_step: np.ndarray, values: np.ndarray):
        order = np.lexsort((step[is_step], clip[is_step]))
        self.clip, self.step, self.shot = (a[is_step][order] for a in (clip, step, shot))
        code = np.unique(step, return_inverse=True)[1]
        key = clip * np.int64(code.max(initial=0) + 1) + code
        steps, faces = key[is_step][order], key[~is_step]
        at = np.searchsorted(steps, faces)
        known = np.flatnonzero((at < len(steps)) & (steps[np.minimum(at, len(steps) - 1)] == faces)) if len(steps) else np.zeros(0, np.int64)
        known = known[np.lexsort((face[~is_step][known], at[known]))]
        self.values = values[:, ~is_step][:, known]
        self.number = np.bincount(at[known], minlength=len(steps))
        self.start = np.cumsum(self.number) - self.number
        begin = np.flatnonzero(np.r_[True, self.clip[1:] != self.clip[:-1]]) if len(steps) else np.zeros(0, np.int64)
        self.nth = np.arange(len(steps)) - np.repeat(begin, np.diff(np.r_[begin, len(steps)]))

    def follow(self, windows, biggest: float, width: int, height: int, steps: int, rounds: int, rules: Rules, strength: float) -> np.ndarray:
        """What ``Frames.search`` finds for each step, all clips one step at a time."""
        found = np.zeros((8, len(self.step)))
        for rows in np.split(np.argsort(self.nth, kind="stable"), np.cumsum(np.bincount(self.nth))[:-1]) if len(self.nth) else ():
            rows = rows[np.argsort(-self.number[rows], kind="stable")]
            number = self.number[rows]
            frame = np.repeat(np.arange(len(rows)), number)
            nth = np.arange(len(frame)) - np.repeat(np.cumsum(number) - number, number)
            padded = np.zeros((6, max(1, number.max()), len(rows), 1, 1))
            padded[:, nth, frame, 0, 0] = self.values[:, self.start[rows][frame] + nth]
            follows = (self.nth[rows] > 0) & (self.shot[rows] == self.shot[rows - 1])
            x, y, w, h = found[:4, rows - 1]
            alone = ~follows & (number == 0)
            middle = (width / 2, height / 2, windows[0][0])
            anchor = [np.where(alone, m, v) for m, v in zip(middle, (x + w / 2, y + h / 2, w))]
            anchor = np.stack([*anchor, np.where(follows | alone, strength, 0.0)]).reshape(4, -1, 1, 1)
            found[:, rows] = Frames(padded[:4], padded[4], number, width, height, padded[5], anchor).search(windows, biggest, steps, rounds, rules)
        return found


def path(
    faces: DataFrame, frames: DataFrame, width: int, height: int, aspect: float, by: str = "clip_id", step: str = "i", shot: str = "shot_id",
    min_scale: float = 0.72, scales: int = 4, steps: int = 16, rounds: int = 3, rules: Rules = Rules(), strength: float = ANCHOR, boost: Column | None = None,
) -> DataFrame:
    """Best crop per step of each clip, drawn to the crop of the step before unless a cut lies between them: columns as of ``solve``.

    ``frames`` has each step once, with its shot; ``faces`` the faces of steps, ``boost`` a factor of their weight (who speaks counts more). The score
    of a window falls by ``strength`` times the way of its centre, in shares of the frame, and .6 of its change of width. Importance is that of the heads, as in ``solve``. A step without faces takes
    all of the frame as alike; the first of a shot is then drawn to the middle of the frame. Faces of steps that ``frames`` lacks are left out.

    Steps of a clip depend on one another, clips do not: clips are dealt to tasks by one shuffle, and the clips of a batch go forward together.
    """
    windows = sizes(width, height, aspect, min_scale, scales)
    biggest = float(math.prod(windows[0]))
    parts = ("x1", "y1", "x2", "y2", "conf", "boost")
    columns = [F.col(c).cast("double").alias(c) for c in parts[:5]] + [(F.lit(1.0) if boost is None else boost).cast("double").alias("boost")]
    number = F.col(step).cast("long").alias("step")
    seen = faces.select(F.col(by).alias("clip"), F.struct(number, F.col("face_no").cast("long").alias("face"), F.lit(None).cast("long").alias("shot"), *columns).alias("row"))
    nothing = [F.lit(None).cast("double").alias(c) for c in parts]
    taken = frames.select(F.col(by).alias("clip"), F.struct(number, F.lit(None).cast("long").alias("face"), F.coalesce(F.col(shot), F.lit(0)).cast("long").alias("shot"), *nothing).alias("row"))
    clips = _dealt(taken.unionByName(seen), "clip").groupBy("clip").agg(F.collect_list("row").alias("rows"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column("rows")
                flat = lists.flatten()
                clip = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                is_step = flat.field("face").is_null().to_numpy(zero_copy_only=False)
                whole = lambda c: flat.field(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
                values = np.stack([flat.field(c).fill_null(0.0).to_numpy(zero_copy_only=False) for c in parts])
                held = _Clips(clip, whole("step"), whole("shot"), whole("face"), is_step, values)
                found = held.follow(windows, biggest, width, height, steps, rounds, rules, strength)
                out = [pa.array(v, pa.float64()).cast(k, safe=False) for v, k in zip(found, (pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("clip").take(pa.array(held.clip)), pa.array(held.step), *out], names=[by, step, "x", "y", "w", "h", "score", "intact", "clipped", "dropped"])

    kinds = dict(x=T.DoubleType(), y=T.DoubleType(), w=T.IntegerType(), h=T.IntegerType(), score=T.DoubleType(), intact=T.IntegerType(), clipped=T.IntegerType(), dropped=T.IntegerType())
    key = T.StructField(by, frames.schema[by].dataType)
    ship(frames.sparkSession)
    return clips.mapInArrow(run, T.StructType([key, T.StructField(step, T.LongType()), *[T.StructField(c, k) for c, k in kinds.items()]]))


#: How a frame is cut for detectors of small faces.
DIVISIONS, LEAST_TILE, TILE_STEP, TILE_BUDGET, LEVELS = (2, 3, 4, 6, 8), 420, 0.75, 80, 4


def tiles(frames: DataFrame, by: str, levels: int = LEVELS, budget: int = TILE_BUDGET) -> DataFrame:
    """The detection pyramid of each frame (by, width, height): by, division, x, y, w, h.

    Divisions as long as a part of the long edge has 420 pixels, the finest ``levels`` of them; a grid's tiles step by three quarters of their
    size and end with the frame. Grids are taken while they fit the ``budget`` of tiles; the first that does not ends the pyramid.
    """
    w, h = F.col("width"), F.col("height")
    fine = F.filter(F.array(*[F.lit(d) for d in DIVISIONS]), lambda d: F.greatest(w, h) / d >= LEAST_TILE)
    kept = F.slice(fine, F.greatest(F.size(fine) - levels + 1, F.lit(1)), F.lit(levels)) if levels else F.slice(fine, 1, 0)

    def starts(size: Column, d: Column) -> Column:
        tile = F.greatest(F.floor(size / d), F.lit(1)).cast("int")
        step = F.greatest(F.floor(tile * TILE_STEP), F.lit(1)).cast("int")
        return F.array_distinct(F.transform(F.sequence(F.lit(0), size - 1, step), lambda x: F.least(x, F.greatest(size - tile, F.lit(0)))))

    grids = frames.select(by, "width", "height", F.posexplode(kept).alias("level", "division"))
    grids = grids.withColumn("xs", starts(w, F.col("division"))).withColumn("ys", starts(h, F.col("division"))).withColumn("n", F.size("xs") * F.size("ys"))
    used = F.sum("n").over(Window.partitionBy(by).orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    fits = grids.withColumn("used", used).filter(F.col("used") <= budget)  # sums only grow, so what follows the first misfit does not fit either
    spots = fits.select(by, "width", "height", "division", "xs", F.explode("ys").alias("y")).select(by, "width", "height", "division", F.explode("xs").alias("x"), "y")
    part = lambda size, at: F.least(F.greatest(F.floor(size / F.col("division")), F.lit(1)), size - F.col(at)).cast("int")
    return spots.select(by, "division", "x", "y", part(w, "x").alias("w"), part(h, "y").alias("h"))
