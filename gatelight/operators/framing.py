"""Choosing spans and stills of a clip, and judging how its crop path frames whoever speaks: window expressions per clip, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weights of a step's worth in a reel, and what a face must fill of a frame or a frame hold of faces to count in full.
WINDOW_WEIGHTS = {"speech": 1.00, "present": 0.45, "dominance": 0.70, "crowding": -0.60, "cut": -1.20, "churn": -1.40}
DOMINANT_SHARE, COMPANY, CROWD, LONG_SHOT = 0.03, 2, 4.0, 0.12
#: Weights of a still's sharpness, face, exposure and distance from cuts, and where each is full.
STILL_WEIGHTS = (0.34, 0.34, 0.17, 0.15)
CRISP, MID_LUMA, LUMA_RANGE, FACE_SHARE, CUT_S, CANDIDATES = 180.0, 128.0, 110.0, 0.05, 0.6, 28
FRAMED, SETTLE_S, CLOSING = 0.9, 0.7, 1.0


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def step_worth(steps: DataFrame, by: str = "clip_id") -> DataFrame:
    """``steps`` (i, speech, faces, largest_share, shot_id, churn) plus ``worth``, the weighted sum of the six terms of a reel's step."""
    faces, order = F.col("faces"), Window.partitionBy(by).orderBy("i")
    terms = {
        "speech": F.col("speech"), "present": (faces > 0).cast("double"), "dominance": F.when(faces > 0, _unit(F.col("largest_share") / DOMINANT_SHARE)).otherwise(0.0),
        "crowding": F.when(faces > 0, _unit((faces - COMPANY) / CROWD)).otherwise(0.0), "cut": F.coalesce((F.col("shot_id") != F.lag("shot_id").over(order)).cast("double"), F.lit(0.0)),
        "churn": F.coalesce(F.col("churn"), F.lit(0.0)),
    }
    worth = F.lit(0.0)
    for name, weight in WINDOW_WEIGHTS.items():
        worth = worth + F.lit(weight) * terms[name]
    return steps.withColumn("worth", worth)


def _best_spans(df: DataFrame, by: list[str], wide: str) -> DataFrame:
    """Per group the first full window of ``wide`` rows (a column, equal in the group) with the largest sum of ``worth`` to 6 places.

    Sums are differences of running sums; the row that ends a window is met by an equi-join on its place, so widths may differ by group.
    """
    order = Window.partitionBy(*by).orderBy("i")
    run = df.withColumn("upto", F.sum("worth").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    ends = run.select(*by, F.col("place").alias("end"), F.col("upto").alias("whole"), F.col("t").alias("end_t"))
    heads = run.select(*by, "i", "t", wide, (F.col("place") + F.col(wide) - 1).alias("end"), (F.col("upto") - F.col("worth")).alias("before"))
    sums = heads.join(ends, [*by, "end"]).withColumn("total", F.round(F.col("whole") - F.col("before"), 6))
    best = sums.groupBy(*by).agg(F.max_by(F.struct("i", "t", "end_t", "total", wide), F.struct("total", -F.col("i"))).alias("b"))
    return best.select(*by, F.col("b.i").alias("start_i"), F.col("b.t").alias("start"), F.col("b.end_t").alias("end"), F.col("b.total").alias("total"), F.col(f"b.{wide}").alias("width"))


def select_window(steps: DataFrame, target: float, least: float = 5.0, by: str = "clip_id") -> DataFrame:
    """Per clip the span for a reel: start and duration in seconds.

    ``steps``: i, t, duration (of the clip), speech, faces, largest_share, shot_id, churn. A clip no longer than ``target`` is taken whole, one of under four
    steps from its start. A shot that holds the whole target wins, by its best mean and a small bonus; else the best window of any.
    """
    order = Window.partitionBy(by).orderBy("i")
    stepped = step_worth(steps, by).withColumn("dt", F.col("t") - F.lag("t").over(order))
    facts = stepped.groupBy(by).agg(F.count("*").alias("n"), F.max("duration").alias("duration"), F.percentile("dt", F.lit(0.5)).alias("pace"))
    rows = stepped.drop("duration").join(facts, by)
    pace = F.greatest(F.coalesce(F.col("pace"), F.lit(0.1)), F.lit(1e-3))
    wide = F.least(F.greatest(F.lit(4), F.bround(F.lit(target) / pace).cast("int")), F.col("n").cast("int"))
    spans = _best_spans(rows.withColumn("wide", wide), [by], "wide").select(by, F.col("start").alias("w_start"), F.col("end").alias("w_end"))

    shots = rows.groupBy(by, "shot_id").agg((F.max("t") - F.min("t")).alias("span"), F.count("*").alias("len"), F.min("i").alias("first_i")).filter(F.col("span") >= target)
    inner = F.least(F.greatest(F.lit(2), F.bround(F.lit(target) / pace).cast("int")), F.col("len").cast("int"))
    within = _best_spans(rows.join(shots, [by, "shot_id"]).withColumn("wide", inner), [by, "shot_id"], "wide").join(shots, [by, "shot_id"])
    within = within.withColumn("value", F.round(F.col("total") / F.col("width") + LONG_SHOT * F.least(F.lit(1.0), F.col("span") / target), 6))
    chosen = within.groupBy(by).agg(F.max_by(F.struct("start", "end"), F.struct("value", -F.col("first_i"))).alias("s")).select(by, F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"))

    all_ = facts.join(spans, by, "left").join(chosen, by, "left")
    single = F.col("s_start").isNotNull()
    length = F.when(single, F.least(F.lit(target), F.col("s_end") - F.col("s_start"))).otherwise(F.greatest(F.lit(least), F.least(F.lit(target), F.col("w_end") - F.col("w_start"))))
    start = F.when(single, F.col("s_start")).otherwise(F.col("w_start"))
    out = all_.withColumn("length", length).withColumn("begin", start)
    fits = F.when(F.col("begin") + F.col("length") > F.col("duration"), F.greatest(F.lit(0.0), F.col("duration") - F.col("length"))).otherwise(F.col("begin"))
    whole, short = F.col("duration") <= target, F.col("n") < 4
    return out.select(
        by, F.when(whole | short, 0.0).otherwise(fits).alias("start"),
        F.when(whole, F.col("duration")).when(short, F.least(F.lit(target), F.col("duration"))).otherwise(F.col("length")).alias("length"), single.alias("single_shot"),
    )


def best_still(frames: DataFrame, by: str = "clip_id") -> DataFrame:
    """Per clip the frame for a still: i, score. ``frames``: i, faces, face_share and face_conf (of the largest), sharpness, luma, cut_distance.

    Frames with faces are tried, or all where none has one: every n-th of them, 28 at most; the first of the best wins. Without a cut the distance is 10 s.
    """
    some = F.max((F.col("faces") > 0).cast("int")).over(Window.partitionBy(by))
    pool = frames.filter("faces is not null").withColumn("some", some).filter((F.col("some") == 0) | (F.col("faces") > 0))
    order = Window.partitionBy(by)
    pool = pool.withColumn("k", F.row_number().over(order.orderBy("i")) - 1).withColumn("n", F.count("*").over(order))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / CANDIDATES))
    tried = pool.filter((F.col("k") % stride == 0) & (F.col("k") / stride < CANDIDATES))
    face = F.when(F.col("faces") > 0, _unit(F.col("face_share") / FACE_SHARE) * 0.7 + 0.3 * _unit(F.col("face_conf"))).otherwise(0.0)
    parts = (_unit(F.col("sharpness") / CRISP), face, _unit(1 - F.abs(F.col("luma") - MID_LUMA) / LUMA_RANGE), _unit(F.coalesce("cut_distance", F.lit(10.0)) / CUT_S))
    score = F.round(sum((w * p for w, p in zip(STILL_WEIGHTS, parts)), F.lit(0.0)), 6)
    return tried.withColumn("score", score).groupBy(by).agg(F.max_by(F.struct("i", "score"), F.struct("score", -F.col("i"))).alias("b")).select(by, "b.i", "b.score")


def framing_coverage(steps: DataFrame, fps: float, by: str = "clip_id", settle: float = SETTLE_S) -> DataFrame:
    """Per clip how often the speaker is inside the crop: strict, settled, speech_steps, framed, in_transit. The shares are null without such steps.

    ``steps``: i, speaker (null if none), face_inside (share of the speaker's face inside the crop, null if the face is not in the frame), face_x, crop_x.
    A step counts as in transit within ``settle`` seconds of a handover while the crop closes in on the speaker by more than a pixel.
    """
    order = Window.partitionBy(by).orderBy("i")
    before = F.last("speaker", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    handed = F.col("speaker").isNotNull() & ~F.col("speaker").eqNullSafe(before)
    at = F.last(F.when(handed, F.col("i")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = steps.withColumn("switch_i", at).withColumn("last_x", F.lag("crop_x").over(order))
    speaks = F.col("speaker").isNotNull() & F.col("face_inside").isNotNull()
    framed = speaks & (F.col("face_inside") >= FRAMED)
    closing = F.abs(F.col("crop_x") - F.col("face_x")) < F.abs(F.col("last_x") - F.col("face_x")) - CLOSING
    moving = speaks & ~framed & (F.col("i") - F.col("switch_i") <= max(1, round(settle * max(fps, 1e-6)))) & F.coalesce(closing, F.lit(False))
    n = marked.groupBy(by).agg(F.count_if(speaks).alias("speech_steps"), F.count_if(framed).alias("framed"), F.count_if(moving).alias("in_transit"))
    share = lambda c: F.when(F.col("speech_steps") > 0, c / F.col("speech_steps"))
    return n.select(by, share(F.col("framed")).alias("strict"), share(F.col("framed") + F.col("in_transit")).alias("settled"), "speech_steps", "framed", "in_transit")


def centre_offset(boxes: DataFrame, by: str, x: Column, y: Column, width: float, height: float) -> DataFrame:
    """Mean distance of centres from the frame's centre, in shares of its sides; one row per group."""
    dx, dy = (x - width / 2) / width, (y - height / 2) / height
    return boxes.groupBy(by).agg(F.coalesce(F.avg(F.sqrt(dx * dx + dy * dy)), F.lit(0.0)).alias("offset"))


def subject_offset(faces: DataFrame, by: str, width: float, height: float) -> DataFrame:
    """Distance of a frame's subjects, weighed by area, from its centre; 0 where all areas are."""
    side = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(0.0))
    area = side("x1", "x2") * side("y1", "y2")
    mean = lambda c: F.sum(c * area) / F.nullif(F.sum(area), F.lit(0.0))
    dx = (mean((F.col("x1") + F.col("x2")) / 2) - width / 2) / width
    dy = (mean((F.col("y1") + F.col("y2")) / 2) - height / 2) / height
    return faces.groupBy(by).agg(F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)).alias("offset"))


def rationale(crops: DataFrame, width: float, height: float) -> DataFrame:
    """``crops`` (x, y, w, h, score, intact, clipped, dropped) plus ``rationale``: the lines that explain a decision, none twice."""
    dx, dy = F.abs(F.col("x") + F.col("w") / 2 - width / 2) / width, F.abs(F.col("y") + F.col("h") / 2 - height / 2) / height
    percent = lambda c: F.format_string("%.1f%%", F.round(c * 100, 1))
    moved = F.concat(F.lit("crop centre is off the frame centre by "), percent(dx), F.lit(" across and "), percent(dy), F.lit(" down, to hold the subject"))
    counted = lambda c, text: F.when(F.col(c) > 0, F.format_string(text, F.col(c)))
    lines = F.array(
        F.when((dx > 0.02) | (dy > 0.02), moved).otherwise("the subject is centred, and so is the crop"), counted("intact", "%d face(s) whole in the frame"),
        counted("dropped", "%d face(s) left out for the primary subject"), counted("clipped", "WARNING: %d face(s) cut"),
    )
    return crops.withColumn("rationale", F.array_distinct(F.array_compact(lines)))
