"""Order-dependent folds over the ordered array of a sequence, as JVM higher-order functions: no Python, one shuffle per fold.

A sequence is one row while it is folded, so its length bounds memory; clips are cut at shots or minutes upstream.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the folds below are held to.
GATE, FLOOR, MARGIN, DWELL = 0.25, 0.30, 0.22, 12
NMS_IOU, NMS_INSIDE = 0.35, 0.72
DEAD_ZONE, HZ, SWITCH_HZ, SWITCH_S, MAX_SPEED, SIZE_HZ = 0.012, 1.1, 4.2, 0.30, 0.85, 0.55
MIN_SHOT, WARMUP, HISTORY = 3, 8, 60

CHUNK = 64  # states gathered at a time: the work of gathering n of them is n * CHUNK, not n * n


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def states(rows: Column, zero: Column, step) -> Column:
    """The state after each element of an array; ``step(state, element)`` returns the next.

    The array is gone through in chunks: a chunk's states are gathered by themselves and then added as one element, so that no long array is copied
    once for each of its elements.
    """
    none = F.slice(F.array(zero), 1, 0)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK)), lambda k: F.slice(rows, (k * CHUNK + 1).cast("int"), F.lit(CHUNK)))

    def one(acc, row):
        return let(step(acc["now"], row), lambda s: F.struct(s.alias("now"), F.concat(acc["out"], F.array(s)).alias("out")))

    def many(acc, chunk):
        begun = F.struct(acc["now"].alias("now"), none.alias("out"))
        return F.aggregate(chunk, begun, one, lambda a: F.struct(a["now"].alias("now"), F.concat(acc["all"], F.array(a["out"])).alias("all")))

    begun = F.struct(zero.alias("now"), F.slice(F.array(none), 1, 0).alias("all"))
    return F.when(F.size(rows) > 0, F.flatten(F.aggregate(chunks, begun, many, lambda acc: acc["all"]))).otherwise(none)


def ordered(df: DataFrame, by: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """One row per group: ``by`` and ``rows``, the array of its rows in ``order``."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in dict.fromkeys(fields) if f not in order]))).alias("rows"))


def fold(df: DataFrame, by: list[str], order: list[str], fields: list[str], zero: Column, step) -> DataFrame:
    """Per group the rows in ``order`` with the state after each: columns of ``by``, ``fields`` and ``state``."""
    fields = list(dict.fromkeys(fields))
    rows = ordered(df, by, order, fields).withColumn("states", states(F.col("rows"), zero, step))
    return rows.select(*by, F.explode(F.arrays_zip("rows", "states")).alias("z")).select(*by, *[F.col(f"z.rows.{f}").alias(f) for f in fields], F.col("z.states").alias("state"))


def hysteresis(steps: DataFrame, by: str, track: str, score: str, gate: str, shot: str, scores: str | None = None, per_shot: bool = False) -> DataFrame:
    """The active track per step from each step's best candidate: a cut clears it, silence and weak scores hold it, and a challenger needs the
    margin over the incumbent's score and the dwell. ``scores`` is a map of the step's scores by track; an incumbent that it lacks is absent and
    counts 0. Without ``scores`` every incumbent counts 0, and the margin, lower than the least score, does not act. A step without a candidate holds. With ``per_shot`` the unit of work is a shot, not a clip, so that a feed of any length
    is dealt out; as a cut clears everything the result is the same, if no shot's number comes back later in its clip."""
    zero = F.struct(F.lit(-1).alias("current"), F.lit(0).alias("dwell"), F.lit(None).cast("int").alias("shot"))

    def step(s, r):
        cut = s["shot"].isNotNull() & (s["shot"] != r[shot])

        def settle(p):
            hold = F.coalesce((r[gate] < GATE) | (r[score] < FLOOR) | r[score].isNull(), F.lit(True))
            incumbent = F.coalesce(F.get(F.filter(r[scores], lambda e: e["key"] == p["current"]), F.lit(0))["value"], F.lit(0.0)) if scores else F.lit(0.0)
            change = ~hold & ((p["current"] == -1) | ((r[track] != p["current"]) & (r[score] >= incumbent + MARGIN) & (p["dwell"] >= DWELL)))
            return let(change, lambda c: F.struct(F.when(c, r[track]).otherwise(p["current"]).alias("current"), F.when(c, 0).otherwise(p["dwell"] + 1).alias("dwell"), r[shot].cast("int").alias("shot")))

        return let(F.struct(F.when(cut, -1).otherwise(s["current"]).alias("current"), F.when(cut, 0).otherwise(s["dwell"]).alias("dwell")), settle)

    if scores:
        steps = steps.withColumn(scores, F.map_entries(scores))  # maps have no order, which the fold's sort asks of its rows
    out = fold(steps, [by, shot] if per_shot else [by], ["i"], ["i", track, score, gate, shot, *([scores] if scores else [])], zero, step)
    return out.select(by, "i", F.col("state.current").alias("active"), F.col("state.dwell").alias("dwell"))


def resolve(steps: DataFrame, by: str, scores: str, gate: str, shot: str, per_shot: bool = False) -> DataFrame:
    """``hysteresis`` from each step's scores of the present tracks alone (a map): the best is the highest, the smaller track on a tie."""
    best = F.array_max(F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("score"), (-e["key"]).alias("rank"))))
    named = steps.withColumn("_best", best)
    named = named.withColumn("best_track", -F.col("_best.rank")).withColumn("best_score", F.col("_best.score")).drop("_best")
    return hysteresis(named, by, "best_track", "best_score", gate, shot, scores, per_shot)


def shot_state(steps: DataFrame, by: str, value: str) -> DataFrame:
    """Shot detector on given frame correlations: a cut needs a value under the threshold of the shot's own history and a shot of 3 frames."""
    zero = F.struct(F.lit(0).alias("shot"), F.lit(0).alias("frames"), F.array().cast("array<double>").alias("seen"), F.lit(False).alias("cut"))

    def median(a):
        n = F.size(a)
        return let(F.array_sort(a), lambda s: (s[F.floor((n - 1) / 2).cast("int")] + s[F.floor(n / 2).cast("int")]) / 2)

    def step(s, r):
        threshold = F.when(F.size(s["seen"]) < WARMUP, 0.70).otherwise(F.least(F.lit(0.92), median(s["seen"]) - 0.10))
        longer = F.concat(s["seen"], F.array(r[value].cast("double")))
        kept = F.slice(longer, F.greatest(F.size(longer) - HISTORY + 1, F.lit(1)), HISTORY)

        def on(cut):
            seen = F.when(cut, F.array().cast("array<double>")).when(r[value].isNull(), s["seen"]).otherwise(kept)
            return F.struct((s["shot"] + cut.cast("int")).alias("shot"), (F.when(cut, 0).otherwise(s["frames"]) + 1).alias("frames"), seen.alias("seen"), cut.alias("cut"))

        return let(r[value].isNotNull() & (r[value] < threshold) & (s["frames"] >= MIN_SHOT), on)

    out = fold(steps, [by], ["i"], ["i", value], zero, step)
    return out.select(by, "i", F.col("state.shot").alias("shot_id"), F.col("state.cut").alias("is_cut"))


_TARGET = ("t", "cx", "cy", "w", "h", "shot_id", "active_track")


def _follower(width: float, height: float):
    """(zero, step) of the critically damped follower on frames of this size."""
    none = F.lit(None).cast("double")
    zero = F.struct(*[none.alias(c) for c in ("x", "y", "w", "vx", "vy", "vw", "timer", "t")], F.lit(None).cast("int").alias("shot"), F.lit(None).cast("int").alias("track"))
    named = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])

    def spring(p, v, g, omega, dt):
        """Position and speed after ``dt``, from the closed form."""
        off = p - g
        pull = named(k=v + omega * off, e=F.exp(-omega * dt))
        return let(pull, lambda q: named(p=g + (off + q["k"] * dt) * q["e"], v=(v - omega * q["k"] * dt) * q["e"]))

    def step(s, r):
        switched = r["active_track"].isNotNull() & ~r["active_track"].eqNullSafe(s["track"])
        first = named(
            dt=F.when(s["t"].isNull(), 1 / 30).otherwise(F.greatest(F.lit(1e-3), F.least(F.lit(0.25), r["t"] - s["t"]))),
            snap=s["x"].isNull() | (s["shot"] != r["shot_id"]), switched=switched, timer=F.when(switched, SWITCH_S).otherwise(s["timer"]),
        )

        def move(f):
            easing, dt = f["timer"] > 0, f["dt"]
            away = F.sqrt(F.pow((r["cx"] - s["x"]) / width, 2) + F.pow((r["cy"] - s["y"]) / height, 2))
            still = ~easing & (away < DEAD_ZONE)
            omega = F.when(easing, 2 * math.pi * SWITCH_HZ).otherwise(2 * math.pi * HZ)
            bleed = F.greatest(F.lit(0.0), 1 - 6 * dt)
            at = lambda p, v: named(p=p, v=v)
            snapped = lambda g: at(g.cast("double"), F.lit(0.0))
            held = lambda p, v: at(p + v * bleed * dt, v * bleed)
            axis = lambda p, v, g, o: F.when(f["snap"], snapped(g)).when(still, held(p, v)).otherwise(spring(p, v, g, o, dt))
            moved = named(
                x=axis(s["x"], s["vx"], r["cx"], omega), y=axis(s["y"], s["vy"], r["cy"], omega), w=axis(s["w"], s["vw"], r["w"], F.lit(2 * math.pi * SIZE_HZ)),
                free=~f["snap"] & ~still, easing=easing,
            )

            def keep(m):
                speed = F.sqrt(m["x"]["v"] * m["x"]["v"] + m["y"]["v"] * m["y"]["v"])
                top = MAX_SPEED * width * F.when(m["easing"], 2.2).otherwise(1.0)
                wide = F.greatest(F.lit(16.0), F.least(F.lit(float(width)), m["w"]["p"]))
                size = named(wide=wide, tall=F.least(wide / (r["w"] / r["h"]), F.lit(float(height))), brake=F.when(m["free"] & (speed > top), top / speed).otherwise(1.0))
                inside = lambda c, half, end: F.greatest(half, F.least(c, end - half))
                return let(size, lambda z: named(
                    x=inside(m["x"]["p"], z["wide"] / 2, float(width)), y=inside(m["y"]["p"], z["tall"] / 2, float(height)), w=z["wide"],
                    vx=m["x"]["v"] * z["brake"], vy=m["y"]["v"] * z["brake"], vw=m["w"]["v"],
                    timer=F.when(f["snap"], 0.0).when(m["easing"], F.greatest(F.lit(0.0), f["timer"] - dt)).otherwise(f["timer"]), t=r["t"],
                    shot=r["shot_id"].cast("int"), track=F.when(f["snap"] | f["switched"], r["active_track"]).otherwise(s["track"]).cast("int"),
                ))

            return let(moved, keep)

        return let(first, move)

    return zero, step


def spring_smooth(targets: DataFrame, by: str, width: float, height: float) -> DataFrame:
    """Critically damped follower of target boxes (i, t, cx, cy, w, h, shot_id, active_track): smoothed centre and width per step.

    A cut snaps; a new active track moves faster for a while; inside the dead zone speed bleeds off. The speed limit acts on the speed kept for the next step.
    """
    out = fold(targets, [by], ["i"], ["i", *_TARGET], *_follower(width, height))
    return out.select(by, "i", F.col("state.x").alias("cx"), F.col("state.y").alias("cy"), F.col("state.w").alias("w"))


def smooth_two_pass(targets: DataFrame, by: str, width: float, height: float) -> DataFrame:
    """The follower run forward, then backward over its own output, and the mean of the two passes; one shuffle for both."""
    zero, step = _follower(width, height)
    rows = ordered(targets, [by], ["i"], ["i", *_TARGET]).withColumn("ahead", states(F.col("rows"), zero, step))
    back = F.transform(F.arrays_zip("rows", "ahead"), lambda z: F.struct((-z["rows"]["t"]).alias("t"), z["ahead"]["x"].alias("cx"), z["ahead"]["y"].alias("cy"), z["ahead"]["w"].alias("w"), *[z["rows"][c].alias(c) for c in ("h", "shot_id", "active_track")]))
    rows = rows.withColumn("turned", F.reverse(back)).withColumn("behind", F.reverse(states(F.col("turned"), zero, step)))
    both = rows.select(by, F.explode(F.arrays_zip("rows", "ahead", "behind")).alias("z"))
    return both.select(by, F.col("z.rows.i").alias("i"), *[((F.col(f"z.ahead.{c}") + F.col(f"z.behind.{c}")) / 2).alias(n) for c, n in (("x", "cx"), ("y", "cy"), ("w", "w"))])


def nms(faces: DataFrame, by: str = "frame_id", overlap: float = NMS_IOU, inside: float = NMS_INSIDE) -> DataFrame:
    """Greedy non-maximum suppression per frame: by confidence, then input order, a box goes if a kept one overlaps or contains it too far.

    Passes over whole frames and tiles go in as one table (``nms_passes``). With ``inside`` of 1 only the overlap counts, as for bodies.
    """
    item = F.struct((-F.col("conf")).alias("neg"), F.col("face_no"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    rows = faces.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    side = lambda lo, hi: F.greatest(hi - lo, F.lit(0.0))
    area = lambda b: side(b["x1"], b["x2"]) * side(b["y1"], b["y2"])

    def clash(k, b):
        common = side(F.greatest(k["x1"], b["x1"]), F.least(k["x2"], b["x2"])) * side(F.greatest(k["y1"], b["y1"]), F.least(k["y2"], b["y2"]))
        whole = area(k) + area(b) - common
        return ((whole > 0) & (common / F.greatest(whole, F.lit(1e-300)) >= overlap)) | ((area(b) > 0) & (common / F.greatest(area(b), F.lit(1e-300)) > inside))

    kept = F.aggregate("rows", F.slice(F.col("rows"), 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: clash(k, b)), acc).otherwise(F.concat(acc, F.array(b))))
    return rows.select(by, F.explode(kept).alias("k")).select(by, "k.face_no", (-F.col("k.neg")).alias("conf"))


def nms_passes(passes: list[DataFrame], by: str = "frame_id", overlap: float = NMS_IOU, inside: float = NMS_INSIDE) -> DataFrame:
    """``nms`` over several passes on the same frames, such as the whole frame and its tiles, in that order: by, pass_no, face_no, conf.

    At equal confidence an earlier pass comes first. Null confidences come before all others, as in ``nms``; give none.
    """
    tagged = [p.select(by, F.struct(F.lit(n).alias("pass_no"), F.col("face_no")).alias("face_no"), "conf", "x1", "y1", "x2", "y2") for n, p in enumerate(passes)]
    kept = nms(reduce(DataFrame.unionByName, tagged), by, overlap, inside)
    return kept.select(by, "face_no.pass_no", "face_no.face_no", "conf")
