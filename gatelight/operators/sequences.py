"""Ordered-sequence operators: every one states its partition and its total order, and runs as JVM window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WARMUP, WARMUP_THRESHOLD, CEILING, DROP, HISTORY = 8, 0.70, 0.92, 0.10, 60
SOFTMAX_T, SOFTMAX_FLOOR = 0.18, 1e-6
MOVING = 5e-4


def _w(by: str, order: str = "i"):
    return Window.partitionBy(by).orderBy(order)


def shot_ids(steps: DataFrame, cut: str, by: str = "clip_id") -> DataFrame:
    """Running count of cuts up to and including the step."""
    return steps.withColumn("shot_id", F.sum(F.col(cut).cast("int")).over(_w(by).rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def running_median_cut(steps: DataFrame, value: str, by: str = "clip_id") -> DataFrame:
    """Threshold from the median of the last 60 values before the step (a fixed one until 8 are seen) and whether the step is below it."""
    past = _w(by).rowsBetween(-HISTORY, -1)
    base = F.percentile(value, F.lit(0.5)).over(past)
    threshold = F.when(F.count(value).over(past) < WARMUP, WARMUP_THRESHOLD).otherwise(F.least(F.lit(CEILING), base - DROP))
    return steps.withColumn("threshold", threshold).withColumn("below", F.col(value) < F.col("threshold"))


def path_motion(steps: DataFrame, width: float, height: float, by: str = "clip_id") -> DataFrame:
    """Per clip the mean, largest and total step of the normalised centre and the share of steps that move; zeros under two points."""
    w = _w(by)
    dx = (F.col("cx") - F.lag("cx").over(w)) / width
    dy = (F.col("cy") - F.lag("cy").over(w)) / height
    d = steps.withColumn("d", F.sqrt(dx * dx + dy * dy))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return d.groupBy(by).agg(zero(F.avg("d")).alias("mean_step"), zero(F.max("d")).alias("max_step"), zero(F.sum("d")).alias("total"), zero(F.avg(F.when(F.col("d").isNotNull(), (F.col("d") > MOVING).cast("double")))).alias("moving_share"))


def subject_motion(steps: DataFrame, width: float, height: float, by: str = "clip_id") -> DataFrame:
    """Diagonal of the range of the normalised centre; 0 under three points."""
    dx = (F.max("cx") - F.min("cx")) / width
    dy = (F.max("cy") - F.min("cy")) / height
    return steps.groupBy(by).agg(F.when(F.count("*") < 3, 0.0).otherwise(F.sqrt(dx * dx + dy * dy)).alias("motion"))


def switches(steps: DataFrame, track: str, by: str = "clip_id") -> DataFrame:
    """Changes of speaker over steps that have one, and distinct speakers. Unassigned steps are left out first."""
    named = steps.filter(F.col(track).isNotNull())
    named = named.withColumn("change", F.col(track) != F.lag(track).over(_w(by)))
    return named.groupBy(by).agg(F.count_if("change").alias("switches"), F.countDistinct(track).alias("speakers"))


def best_window(steps: DataFrame, score: Column, width: int, by: list[str]) -> DataFrame:
    """Per group the first of the full windows of ``width`` steps with the largest sum (to 6 places): start and total."""
    w = Window.partitionBy(*by).orderBy("i")
    ahead = w.rowsBetween(0, width - 1)
    sums = steps.withColumn("s", F.round(F.sum(score).over(ahead), 6)).withColumn("n", F.count("*").over(ahead)).filter(F.col("n") == width)
    return sums.groupBy(*by).agg(F.max_by(F.struct("i", "s"), F.struct("s", -F.col("i"))).alias("b")).select(*by, F.col("b.i").alias("start_i"), F.col("b.s").alias("total"))


def churn(steps: DataFrame, track: str, width: int, by: str = "clip_id") -> DataFrame:
    """Centred moving mean of switch marks; beyond the ends counts as no switch."""
    w = _w(by)
    mark = F.coalesce((F.col(track) != F.lag(track).over(w)).cast("double"), F.lit(0.0))
    half = width // 2
    return steps.withColumn("mark", mark).withColumn("churn", F.sum("mark").over(w.rowsBetween(-half, width - 1 - half)) / width).drop("mark")


def runs(steps: DataFrame, key: str, by: str = "clip_id") -> DataFrame:
    """Maximal runs of equal ``key`` in order: run, key, first and last step, length."""
    w = _w(by)
    new = F.coalesce(~F.col(key).eqNullSafe(F.lag(key).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    marked = steps.withColumn("run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "run").agg(F.first(key).alias(key), F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count("*").alias("n"))


def softmax(rows: DataFrame, score: str, by: list[str], temperature: float = SOFTMAX_T) -> DataFrame:
    """Probability of each present track among those of its step; 0 where no score of the step exceeds the floor."""
    w = Window.partitionBy(*by)
    top = F.max(score).over(w)
    weight = F.exp((F.col(score) - top) / temperature)
    return rows.withColumn("p", F.when(top <= SOFTMAX_FLOOR, 0.0).otherwise(weight / F.sum(weight).over(w)))


def gradient(steps: DataFrame, value: str, by: str = "clip_id") -> DataFrame:
    """Absolute central difference, one-sided at the ends, 0 for a single step."""
    w = _w(by)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    step = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)
    return steps.withColumn("gradient", F.abs(step))


def presence_gap(steps: DataFrame, seen: str, by: str = "clip_id") -> DataFrame:
    """Coverage and the longest time since the subject was last seen; what comes before its first sight does not count."""
    last = F.last(F.when(F.col(seen), F.col("t")), ignorenulls=True).over(_w(by).rowsBetween(Window.unboundedPreceding, 0))
    gap = steps.withColumn("gap", F.when(~F.col(seen), F.col("t") - last))
    return gap.groupBy(by).agg(F.count("*").alias("samples"), F.avg(F.col(seen).cast("double")).alias("coverage"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("longest_gap_s"))


def speech_ratio(steps: DataFrame, by: str = "clip_id") -> DataFrame:
    return steps.groupBy(by).agg(F.coalesce(F.avg((F.col("speech") > 0.5).cast("double")), F.lit(0.0)).alias("speech_ratio"))


def percentiles(steps: DataFrame, value: str, by: str = "clip_id") -> DataFrame:
    """25th and 95th percentile, median step in time, median if over two samples else the largest."""
    step = F.col("t") - F.lag("t").over(_w(by))
    rows = steps.withColumn("dt", step)
    median = F.when(F.count(value) > 2, F.percentile(value, F.lit(0.5))).otherwise(F.max(value))
    return rows.groupBy(by).agg(F.percentile(value, F.lit(0.25)).alias("p25"), F.percentile(value, F.lit(0.95)).alias("p95"), F.percentile("dt", F.lit(0.5)).alias("median_dt"), median.alias("typical"))


def significant(faces: DataFrame, height: Column, frame_height: float, relative: float = 0.45, fraction: float = 0.055, by: str = "frame_id") -> DataFrame:
    """Faces of subjects: comparable to the tallest of the frame, or tall enough within the frame."""
    top = F.max(height).over(Window.partitionBy(by))
    return faces.withColumn("subject", (height >= relative * top) | (height >= fraction * frame_height))


def confident(faces: DataFrame, least: float, pixels: float = 10.0) -> DataFrame:
    """Detections sure enough and at least ``pixels`` wide and tall."""
    return faces.filter((F.col("conf") >= least) & (F.col("x2") - F.col("x1") >= pixels) & (F.col("y2") - F.col("y1") >= pixels))


def confirmed(faces: DataFrame, sure: float = 0.85) -> DataFrame:
    """Detections whose mouth was measured, and those sure enough without."""
    return faces.filter(F.col("mouth").isNotNull() | (F.col("conf") >= sure))


def speaker_face(steps: DataFrame, faces: DataFrame, by: list[str], track: str = "track") -> DataFrame:
    """``steps`` with the values of the speaker's own detection in the frame, null where there is none; of several the smallest row counts."""
    rest = [c for c in faces.columns if c not in (*by, track)]
    one = faces.groupBy(*by, track).agg(F.min(F.struct(*rest)).alias("f")).select(*by, F.col(track).alias("speaker"), *[F.col(f"f.{c}").alias(c) for c in rest])
    return steps.join(one, [*by, "speaker"], "left")


def best_of_step(rows: DataFrame, by: list[str], track: str, score: str) -> DataFrame:
    """The highest score per step and its track, the smaller track on a tie."""
    top = F.max_by(F.struct(track, score), F.struct(F.col(score), -F.col(track)))
    return rows.groupBy(*by).agg(top.alias("b")).select(*by, F.col(f"b.{track}").alias(track), F.col(f"b.{score}").alias(score))


def presence(steps: DataFrame, seen: DataFrame, by: str, track: str, edge: float = 1e-6) -> DataFrame:
    """Steps at which each track is present: from its first detection to its last. Spans are few per clip and join on the clip."""
    spans = seen.groupBy(by, track).agg(F.min("t").alias("_from"), F.max("t").alias("_to"))
    return steps.join(spans, by).filter(F.col("t").between(F.col("_from") - edge, F.col("_to") + edge)).drop("_from", "_to")


def hann(steps: DataFrame, value: str, width: int, by: str = "clip_id") -> DataFrame:
    """``value`` smoothed by a Hann window of ``width`` steps as ``smooth``; zeros beyond the ends, unchanged in clips shorter than the window."""
    import math

    raw = [0.5 - 0.5 * math.cos(2 * math.pi * k / (width - 1)) for k in range(width)] if width > 1 else [1.0]
    w, half = _w(by), (width - 1) // 2
    parts = [F.coalesce(F.lag(value, k - half).over(w), F.lit(0.0)) * (x / sum(raw)) for k, x in enumerate(raw) if x > 1e-15]
    smooth = sum(parts[1:], parts[0])
    return steps.withColumn("smooth", F.when(F.count("*").over(Window.partitionBy(by)) < width, F.col(value)).otherwise(smooth))


def cut_marks(steps: DataFrame, shot: str, by: str = "clip_id") -> DataFrame:
    """1 where the shot differs from the step before, else 0."""
    return steps.withColumn("cut", F.coalesce((F.col(shot) != F.lag(shot).over(_w(by))).cast("int"), F.lit(0)))


def min_max(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``value`` between its group's extremes as ``level``, 0 where the group is flat."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("level", F.when(hi - lo < 1e-8, 0.0).otherwise((F.col(value) - lo) / (hi - lo)))


def path_summary(steps: DataFrame, x: str, cut: str, track: str, by: str = "clip_id") -> DataFrame:
    """Way the crop goes sideways, cuts and distinct speakers per clip."""
    moved = steps.withColumn("_d", F.abs(F.col(x) - F.lag(x).over(_w(by))))
    return moved.groupBy(by).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("travel"), F.count_if(cut).alias("cuts"), F.countDistinct(track).alias("speakers"))


def face_weight(faces: DataFrame, by: str = "frame_id", speaking: Column | None = None, is_speaker: Column | None = None) -> DataFrame:
    """``faces`` with ``weight``: the root of the area beside the frame's largest, by confidence; who speaks counts more."""
    area = F.greatest(F.col("x2") - F.col("x1"), F.lit(0.0)) * F.greatest(F.col("y2") - F.col("y1"), F.lit(0.0))
    top = F.max(area).over(Window.partitionBy(by))
    weight = F.sqrt(F.greatest(F.when(top > 0, area / top).otherwise(1.0), F.lit(0.02))) * (0.55 + 0.45 * F.col("conf"))
    louder = weight if speaking is None else weight * (1 + 0.8 * F.greatest(speaking, F.lit(0.0)))
    return faces.withColumn("weight", louder if is_speaker is None else F.when(is_speaker, weight * 2.2).otherwise(louder))


def primary_subject(faces: DataFrame, width: float, height: float, by: str = "frame_id") -> DataFrame:
    """The face of the largest weight times head area (to 4 places) per frame, the first on a tie."""
    from gatelight.functions import boxes

    head = boxes.clamp(boxes.head(boxes.box("x1", "y1", "x2", "y2")), width, height)
    rated = face_weight(faces, by).withColumn("_r", F.round(F.col("weight") * boxes.area(head), 4))
    return rated.groupBy(by).agg(F.max_by("face_no", F.struct("_r", -F.col("face_no"))).alias("face_no"))


def first_mentions(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Each value of ``by`` once, numbered (``place``, from 1) in the order of first appearance; repeats go before anything is sorted."""
    first = df.groupBy(by, value).agg(F.min(F.struct(*order)).alias("_first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("_first"))).select(by, "place", value)
