"""Compliance rules as columns: each applicable rule of a row becomes a result row, and results fold into a verdict and a gate.

A rule that does not apply emits no row. Only a failed rule of severity error blocks publication; warnings and skips never do. All limits are
columns of the row, joined from the profile sheet (``gatelight.plans.spec.profile_table``), so that a sheet's own numbers decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatelight.functions import boxes

PASS, WARN, FAIL, SKIP = "pass", "warn", "fail", "skip"
OUTCOMES = (PASS, WARN, FAIL, SKIP)

#: Tolerances that no sheet states.
ASPECT_TOLERANCE = 0.012
GONE, TIGHT_HEAD, SAFE_INSIDE, RESERVED_OVERLAP = 0.02, 0.90, 0.97, 0.12
RATE_OK, RATE_WARN = 0.05, 0.20
SUBJECT_MOVED, LEAST_TRAVEL, OFF_CENTRE, CENTRED = 0.02, 0.01, 0.04, 0.01
EVIDENCE = 12  # offences listed; all are counted
DETAILS = ("expected", "actual", "evidence")
FACE_LIMITS = ("clip_tolerance", "relative_size", "frame_fraction", "action", "reserved")  # of a sheet's columns, those that ``face_facts`` looks at
OFFENCES = ("clipped", "extra", "tight", "safe", "reserved")


@dataclass(frozen=True)
class Rule:
    """``outcome`` is one of OUTCOMES; ``applies`` null or false means no row. ``severity`` is that of a failure.

    ``expected`` and ``actual`` are short texts, ``evidence`` a JSON text. A rule of a user's own is one more of these in the list that
    ``evaluate`` gets. A null outcome (a measurement that could not be judged) counts as a failure.
    """

    id: str
    severity: str
    applies: Column
    outcome: Column
    expected: Column | None = None
    actual: Column | None = None
    evidence: Column | None = None

    def result(self, details: tuple[str, ...]) -> Column:
        text = lambda c: (F.lit(None) if c is None else c).cast("string")
        row = F.struct(F.lit(self.id).alias("rule_id"), F.lit(self.severity).alias("level"), self.outcome.alias("outcome"), *[text(getattr(self, d)).alias(d) for d in details])
        return F.when(self.applies, row)


def ok_unless(bad: Column, otherwise: str = FAIL) -> Column:
    return F.when(bad, otherwise).otherwise(PASS)


def fixed(value: Column, places: int, unit: str = "") -> Column:
    """A number to so many places, halves away from zero, with its unit."""
    return F.format_string(f"%.{places}f{unit.replace('%', '%%')}", F.round(value.cast("double"), places))


def _ranged(rule: str, severity: str, column: str, lo: str, hi: str, outside: str, places: int, unit: str) -> Rule:
    value = F.col(column)
    bounds = F.concat(F.col(lo).cast("string"), F.lit("-"), F.col(hi).cast("string"), F.lit(unit))
    outcome = F.when(value.isNull(), WARN).when(~value.between(F.col(lo), F.col(hi)), outside).otherwise(PASS)
    actual = F.when(value.isNull(), "unknown").otherwise(fixed(value, places, unit))
    return Rule(rule, severity, F.col("kind").eqNullSafe("video") & F.col(lo).isNotNull(), outcome, bounds, actual)


def technical_rules(columns: list[str]) -> list[Rule]:
    """The technical and quality rules whose measurements are among ``columns``.

    Expected: the profile's columns, width, height, and any of container, video_codec, pix_fmt, audio_codec, audio_channels, audio_rate, fps,
    duration_s, bitrate_kbps, size_bytes, letterbox (worst sample), sharpness (typical sample), luma (mean of the samples).
    """
    has = set(columns).issuperset
    video, true = F.col("kind") == "video", F.lit(True)
    size = lambda w, h: F.concat_ws("x", F.col(w).cast("string"), F.col(h).cast("string"))
    rules = [
        Rule("tech.dimensions", "error", true, ok_unless((F.col("width") != F.col("want_w")) | (F.col("height") != F.col("want_h"))), size("want_w", "want_h"), size("width", "height")),
        _aspect(),
    ]
    if has(["container", "video_codec"]):
        rules.append(_container(has(["pix_fmt"])))
    if has(["audio_codec"]):
        rules.append(_audio(has(["audio_channels"]), has(["audio_rate"])))
    if has(["fps"]):
        rules.append(_ranged("tech.frame_rate", "error", "fps", "fps_lo", "fps_hi", FAIL, 2, " fps"))
    if has(["duration_s"]):
        rules.append(_ranged("tech.duration", "error", "duration_s", "duration_lo", "duration_hi", FAIL, 2, "s"))
    if has(["bitrate_kbps"]):
        rules.append(_ranged("tech.bitrate", "warning", "bitrate_kbps", "bitrate_lo", "bitrate_hi", WARN, 0, " kbps"))
    if has(["size_bytes"]):
        mb = F.col("size_bytes") / (1024 * 1024)
        rules.append(Rule("tech.file_size", "error", true, ok_unless(mb > F.col("max_mb")), F.concat(F.lit("<= "), fixed(F.col("max_mb"), 0, " MB")), fixed(mb, 2, " MB")))
    if has(["letterbox"]):
        worst = F.col("letterbox")
        rules.append(_sampled("quality.letterbox", "error", worst, ok_unless(worst > F.col("max_letterbox")), F.concat(F.lit("<= "), fixed(F.col("max_letterbox") * 100, 1, "%")), fixed(worst * 100, 2, "%")))
    if has(["sharpness"]):
        sharp = F.col("sharpness")
        rules.append(_sampled("quality.sharpness", "error", sharp, ok_unless(sharp < F.col("min_sharpness")), F.concat(F.lit(">= "), fixed(F.col("min_sharpness"), 0)), fixed(sharp, 1)))
    if has(["luma"]):
        luma, bounds = F.col("luma"), F.concat_ws("-", F.col("luma_lo").cast("string"), F.col("luma_hi").cast("string"))
        rules.append(_sampled("quality.luminance", "warning", luma, ok_unless(~luma.between(F.col("luma_lo"), F.col("luma_hi")), WARN), bounds, fixed(luma, 1)))
    return rules


def _sampled(rule: str, severity: str, value: Column, outcome: Column, expected: Column, actual: Column) -> Rule:
    """A rule on sampled frames: without a sample there is nothing to judge."""
    there = value.isNotNull()
    return Rule(rule, severity, F.lit(True), F.when(~there, SKIP).otherwise(outcome), F.when(there, expected), F.when(there, actual))


def _aspect() -> Rule:
    actual = F.when(F.col("height") != 0, F.col("width") / F.col("height")).otherwise(0.0)
    off = F.when(F.col("ratio_value") != 0, F.abs(actual - F.col("ratio_value")) / F.col("ratio_value")).otherwise(1.0)
    return Rule("tech.aspect_ratio", "error", F.lit(True), ok_unless(off > ASPECT_TOLERANCE), F.col("ratio"), fixed(actual, 4))


def _container(pixels: bool) -> Rule:
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    bad = (~F.contains(low("container"), F.lower("want_container")) & ~low("container").isin("mp4", "mov")) | (low("video_codec") != F.lower("want_video_codec"))
    pix = low("pix_fmt") if pixels else F.lit("")
    bad = bad | ((pix != "") & (pix != F.lower("want_pix_fmt")))
    shown = F.when(pix == "", "unknown").otherwise(pix)
    return Rule("tech.container_codec", "error", F.col("kind") == "video", ok_unless(bad), F.concat_ws("/", "want_container", "want_video_codec", "want_pix_fmt"), F.concat_ws("/", low("container"), low("video_codec"), shown))


def _audio(channels: bool, hz: bool) -> Rule:
    codec = F.coalesce(F.col("audio_codec"), F.lit(""))
    n, rate = (F.coalesce(F.col(c), F.lit(0)) if there else F.lit(0) for c, there in (("audio_channels", channels), ("audio_rate", hz)))
    bad = (F.lower(codec) != F.lower("want_audio_codec")) | ((n != 0) & (n != F.col("want_channels"))) | ((rate != 0) & (rate != F.col("want_rate")))
    show = lambda c, a, b: F.format_string("%s/%dch/%dHz", c, a, b)
    expected = F.when(codec == "", F.col("want_audio_codec")).otherwise(show(F.col("want_audio_codec"), F.col("want_channels"), F.col("want_rate")))
    return Rule("tech.audio", "error", F.col("kind") == "video", ok_unless(bad), expected, F.when(codec == "", "none").otherwise(show(codec, n, rate)))


def sample_facts(samples: DataFrame, by: str = "media_id", at: str = "t") -> DataFrame:
    """Per medium what its sampled frames say: samples, with_face, letterbox (worst), luma (mean), sharpness (median of more than two, else largest),
    coverage and longest_gap (time since a face was last seen; what comes before the first does not count).

    ``samples``: by, sample, t, faces, letterbox, luma, sharpness.
    """
    order = Window.partitionBy(by).orderBy("sample").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.col("faces") > 0
    gap = samples.withColumn("gap", F.when(~seen, F.col(at) - F.last(F.when(seen, F.col(at)), ignorenulls=True).over(order)))
    typical = F.when(F.count("sharpness") > 2, F.percentile("sharpness", F.lit(0.5))).otherwise(F.max("sharpness"))
    return gap.groupBy(by).agg(
        F.count("*").alias("samples"), F.count_if(seen).alias("with_face"), F.max("letterbox").alias("letterbox"), F.avg("luma").alias("luma"),
        typical.alias("sharpness"), F.avg(seen.cast("double")).alias("coverage"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("longest_gap"),
    )


def _share(inner: tuple[str, ...], outer: tuple[str, ...]) -> str:
    """SQL of the share of one box that lies inside another, 0 for an empty box."""
    (a, b, c, d), (x, y, z, w) = inner, outer
    common = f"greatest(least({c}, {z}) - greatest({a}, {x}), 0D) * greatest(least({d}, {w}) - greatest({b}, {y}), 0D)"
    return f"coalesce({common} / nullif(greatest({c} - {a}, 0D) * greatest({d} - {b}, 0D), 0D), 0D)"


def face_facts(faces: DataFrame, media: DataFrame, by: str = "media_id", evidence: bool = True) -> DataFrame:
    """Per medium what its sampled faces say: counts of faces, subjects and each kind of offence, and with ``evidence`` the first offences of each kind.

    Counts are one aggregate over faces. Evidence ranks offences with a limit that acts before the shuffle: of a medium with a million offences a task
    hands on twelve of a kind.

    ``faces``: by, sample, t, face_no, x1, y1, x2, y2. ``media``: by, width, height and the profile's columns. A face is a subject by its height
    beside the tallest of its frame or the frame itself. Its core decides whether it is cut, leaves the action-safe area or lies under
    reserved zones (one face may lie under several); a subject whole but for its head is noted as tight.
    """
    # plain columns in three projections: as nested box structs the same plan takes seconds to build and compile
    left, above, right, below = boxes.HEAD_PAD
    shrink = -boxes.CORE_SHRINK / 2
    facts = media.select(by, "width", "height", *FACE_LIMITS)
    # each frame's tallest face is found before the limits are joined: what is sorted is a face's own few columns, not its profile's zones, and dealt out by medium the join needs no sort more
    tallest = F.max(F.expr("greatest(y2 - y1, 0D)")).over(Window.partitionBy(by, "sample"))
    f = faces.repartition(by).select(by, "sample", "t", "face_no", "x1", "y1", "x2", "y2", tallest.alias("top"))
    f = f.join(facts, by).selectExpr("*", "greatest(x2 - x1, 0D) as fw", "greatest(y2 - y1, 0D) as fh")
    f = f.withColumn("subject", F.expr("fh >= relative_size * top or fh >= frame_fraction * height"))
    core = [f"x1 + {shrink}D * fw as c1", f"y1 + {shrink}D * fh as c2", f"x2 - {shrink}D * fw as c3", f"y2 - {shrink}D * fh as c4"]
    head = [f"x1 - {left}D * fw as h1", f"y1 - {above}D * fh as h2", f"x2 + {right}D * fw as h3", f"y2 + {below}D * fh as h4"]
    f = f.selectExpr(by, "sample", "t", "face_no", "subject", *core, *head, "cast(width as double) as width", "cast(height as double) as height", "clip_tolerance", "action", "reserved")
    zone = lambda z: (f"{z}.x1 * width", f"{z}.y1 * height", f"{z}.x2 * width", f"{z}.y2 * height")
    core, frame = ("c1", "c2", "c3", "c4"), ("0D", "0D", "width", "height")
    under = f"filter(transform(reserved, z -> struct('reserved' as kind, {_share(core, zone('z.rect'))} as share, z.name as zone)), z -> z.share > {RESERVED_OVERLAP}D)"
    f = f.selectExpr(by, "sample", "t", "face_no", "subject", "clip_tolerance", f"{_share(core, frame)} as inside", f"{_share(('h1', 'h2', 'h3', 'h4'), frame)} as head", f"case when action is not null then {_share(core, zone('action'))} end as safe", f"case when subject then {under} end as under")
    f = f.withColumn("whole", F.expr("inside >= clip_tolerance")).withColumn("cut", F.expr(f"inside < clip_tolerance and inside > {GONE}D"))
    offence = lambda kind, value, when: f"case when {when} then struct('{kind}' as kind, round({value}, 4) as share, cast(null as string) as zone) end"
    own = ", ".join([offence("clipped", "inside", "cut and subject"), offence("extra", "inside", "cut and not subject"), offence("tight", "head", f"whole and subject and head < {TIGHT_HEAD}D"), offence("safe", "safe", f"subject and safe < {SAFE_INSIDE}D")])
    counts = {"clipped": "cut and subject", "extra": "cut and not subject", "tight": f"whole and subject and head < {TIGHT_HEAD}D", "safe": f"subject and safe < {SAFE_INSIDE}D"}
    counted = [F.count_if(F.expr(when)).alias(f"n_{k}") for k, when in counts.items()] + [F.sum(F.expr("case when under is null then 0 else size(under) end")).alias("n_reserved")]
    worst = F.min(F.expr("case when cut and subject then inside end")).alias("worst")
    per_face = f.groupBy(by).agg(F.count("*").alias("faces"), F.count_if("subject").alias("subjects"), worst, *counted)
    if not evidence:
        return per_face
    listed_under = "coalesce(transform(under, z -> struct(z.kind as kind, round(z.share, 4) as share, z.zone as zone)), array())"
    f = f.selectExpr(by, "sample", "t", "face_no", f"concat(array_compact(array({own})), {listed_under}) as offences")
    # outer: from a plain explode Spark infers a filter on the lists' size and works every face out twice, once for it within the join
    each = f.select(by, "sample", "t", "face_no", F.explode_outer("offences").alias("o")).filter("o is not null").select(by, "sample", "t", "face_no", "o.*")
    nth = F.row_number().over(Window.partitionBy(by, "kind").orderBy("sample", "face_no", "zone"))
    listed = F.struct("sample", "face_no", F.round("t", 3).alias("timestamp_s"), "zone", "share")
    first = each.withColumn("nth", nth).filter(F.col("nth") <= EVIDENCE)
    per_kind = first.groupBy(by).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, listed))).alias(f"first_{k}") for k in OFFENCES])
    return per_face.join(per_kind, by, "left")


def subject_rules(listed: bool = True) -> list[Rule]:
    """The rules on sampled faces, over columns of ``sample_facts`` and ``face_facts`` (null where a medium has none) and source_has_faces. ``listed``: the facts have evidence."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    sampled = n("samples") > 0
    evidence = lambda *ks: F.to_json(F.struct("faces", "subjects", *[F.col(f"n_{k}") for k in ks], *[F.col(f"first_{k}") for k in ks])) if listed else None
    percent = lambda c, p=0: fixed(c * 100, p, "%")

    clipped, extra, tight = (n(f"n_{k}") > 0 for k in ("clipped", "extra", "tight"))
    integrity = F.when(~sampled, SKIP).when(clipped, FAIL).when(n("faces") == 0, SKIP).when(extra | tight, WARN).otherwise(PASS)
    wanted = F.when(clipped, F.concat(F.lit(">= "), percent(F.col("clip_tolerance"), 1), F.lit(" of every subject kept"))).when(extra, "all subjects whole").when(tight, "all faces whole").otherwise("all subjects whole")
    seen = F.when(clipped, F.concat(percent(F.col("worst"), 1), F.lit(" is the least kept"))).when(extra, "other faces cut").when(tight, "little room round a head").otherwise("none")
    judged = sampled & (n("faces") > 0)

    none = ~F.col("require_subject") | ~sampled | ~F.coalesce(F.col("source_has_faces"), F.lit(False))
    image = F.col("kind") == "image"
    lost, thin = F.round("longest_gap", 6) > F.col("max_absence"), F.col("coverage") < F.col("min_coverage")
    presence = F.when(none, SKIP).when(F.when(image, F.col("with_face") == 0).otherwise(lost | thin), FAIL).otherwise(PASS)
    limit = F.format_string("%.1fs", F.col("max_absence"))
    least = F.concat(F.lit(">= "), percent(F.col("min_coverage")))
    p_expected = F.when(image, "subject present").when(lost, F.concat(F.lit("no absence longer than "), limit)).when(thin, least).otherwise(F.concat(least, F.lit(", no gap over "), limit))
    p_actual = F.when(image, F.when(F.col("with_face") > 0, "present").otherwise("absent")).when(lost, fixed(F.col("longest_gap"), 2, "s")).otherwise(percent(F.col("coverage"), 1))

    def banded(rule: str, kind: str, applies: Column, expected: str, fine: str, word: str) -> Rule:
        rate = n(f"n_{kind}") / F.greatest(n("subjects"), F.lit(1))
        outcome = F.when(n("subjects") == 0, SKIP).when(rate <= RATE_OK, PASS).when(rate <= RATE_WARN, WARN).otherwise(FAIL)
        there = n("subjects") > 0
        return Rule(rule, "error", applies, outcome, F.when(there, expected), F.when(there, F.when(rate <= RATE_OK, fine).otherwise(F.concat(percent(rate), F.lit(f" {word}")))), evidence(kind))

    return [
        Rule("subject.face_integrity", "error", F.lit(True), integrity, F.when(judged, wanted), F.when(judged, seen), evidence("clipped", "extra", "tight")),
        Rule("subject.presence", "error", F.lit(True), presence, F.when(~none, p_expected), F.when(~none, p_actual), F.to_json(F.struct("samples", "with_face", "coverage", "longest_gap"))),
        banded("subject.safe_zone", "safe", F.col("action").isNotNull(), "subjects inside the safe area", "within", "outside"),
        banded("subject.reserved_zone", "reserved", F.size("reserved") > 0, "reserved zones free of faces", "clear", "overlapping"),
    ]


def hint_rules() -> list[Rule]:
    """Rules judged from the renderer's own hints: moving_fraction, total_travel, subject_motion, speaker_coverage, speech_steps, subject_offset, crop_offset.

    They are only as honest as the hints; a null hint skips, as the outcome of nothing measured.
    """
    video, percent = F.col("kind") == "video", lambda c, p=0: fixed(c * 100, p, "%")
    moving, travel = F.col("moving_fraction"), F.coalesce(F.col("total_travel"), F.lit(0.0))
    moved = F.col("subject_motion").isNull() | (F.col("subject_motion") > SUBJECT_MOVED)
    static, held = (1 - moving >= F.col("max_static")) & moved, (travel < LEAST_TRAVEL) & moved
    there = moving.isNotNull()
    needed = F.concat(F.lit("movement in over "), percent(1 - F.col("max_static")), F.lit(" of frames"))
    m_actual = F.when(static, F.concat(F.lit("moves in "), percent(moving, 1))).when(held, "hardly any travel").when(~moved, "nothing to follow").otherwise(F.concat(F.lit("moving in "), percent(moving, 1), F.lit(" of frames")))

    coverage = F.col("speaker_coverage")
    silent = coverage.isNull() | (F.coalesce(F.col("speech_steps"), F.lit(0)) == 0)

    offset, crop = F.col("subject_offset"), F.col("crop_offset")
    unknown = offset.isNull() | crop.isNull()
    centred = (offset > OFF_CENTRE) & (crop < CENTRED)
    c_actual = F.when(centred, "centred crop of an off-centre subject").when(offset <= OFF_CENTRE, "subject in the middle").otherwise(F.concat(F.lit("crop offset "), percent(crop, 1)))
    return [
        Rule("subject.reframe_motion", "error", video, F.when(~there, SKIP).otherwise(ok_unless(static | held)), F.when(there, F.when(static, needed).otherwise("the crop goes along")), F.when(there, m_actual), F.to_json(F.struct("moving_fraction", "total_travel", "subject_motion"))),
        Rule("subject.active_speaker", "error", video, F.when(silent, SKIP).otherwise(ok_unless(coverage < F.col("min_speaker"))), F.when(~silent, F.concat(F.lit(">= "), percent(F.col("min_speaker")), F.lit(" of speech time"))), F.when(~silent, percent(coverage, 1)), F.to_json(F.struct("speech_steps", "speaker_coverage"))),
        Rule("subject.crop_provenance", "warning", F.lit(True), F.when(unknown, SKIP).otherwise(ok_unless(centred, WARN)), F.when(~unknown, "crop and subject off centre alike"), F.when(~unknown, c_actual), F.to_json(F.struct("crop_offset", "subject_offset"))),
    ]


def with_profile(media: DataFrame, sheet: DataFrame) -> DataFrame:
    """Media rows with the limits of their profile; a sheet is a few rows, fixed by its file."""
    return media.join(F.broadcast(sheet), "profile_id")


def gathered(media: DataFrame, sheet: DataFrame, samples: DataFrame, faces: DataFrame, hints: DataFrame, by: str = "media_id", evidence: bool = True) -> DataFrame:
    """One row per medium with everything that ``all_rules`` looks at, lists of offences only with ``evidence``. Samples, faces and hints are reduced per medium before they are joined."""
    judged = with_profile(media, sheet)
    return judged.join(sample_facts(samples, by), by, "left").join(face_facts(faces, judged, by, evidence), by, "left").join(hints, by, "left")


def under_sheet(facts: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame | None:
    """Rows as of ``gathered`` under the ``old`` sheet with the limits of the ``new`` one; None if they must be gathered again, as the two differ in a limit
    that faces are counted by or the old one lacks a profile. Both sheets are a few rows."""
    held, wanted = ({r["profile_id"]: tuple(r) for r in sheet.select("profile_id", *FACE_LIMITS).collect()} for sheet in (old, new))
    if any(held.get(p) != row for p, row in wanted.items()):
        return None
    return with_profile(facts.drop(*[c for c in old.columns if c != "profile_id"]), new).select(*facts.columns)


def all_rules(columns: list[str]) -> list[Rule]:
    """Every rule, in the order reports list them."""
    return [*technical_rules(columns), *subject_rules("first_safe" in columns), *hint_rules()]


def evaluate(df: DataFrame, keys: list[str], rules: list[Rule], details: tuple[str, ...] = DETAILS) -> DataFrame:
    """One row per key and applicable rule: rule_id, outcome, severity and the ``details`` asked for (of expected, actual, evidence). One projection and one explode; no shuffle.

    What no one reads must not be asked for: rows pass through an array of structs, which hides unread fields from the optimiser.
    """
    results = F.array_compact(F.array(*[r.result(details) for r in rules]))
    rows = df.select(*keys, F.explode(results).alias("r")).select(*keys, "r.*").withColumn("outcome", F.coalesce("outcome", F.lit(FAIL)))
    level = F.when(F.col("outcome") == FAIL, F.col("level")).when(F.col("outcome") == WARN, "warning").otherwise("info")
    return rows.select(*keys, "rule_id", "outcome", level.alias("severity"), *details)


def display_order(results: DataFrame, keys: list[str]) -> DataFrame:
    """``results`` with ``place``: failures first, then warnings, passes and skips, by rule id within each."""
    rank = F.when(F.col("outcome") == FAIL, 0).when(F.col("outcome") == WARN, 1).when(F.col("outcome") == PASS, 2).otherwise(3)
    return results.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, "rule_id")))


def summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Rules per outcome, zero where none."""
    return results.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES])


def gate(results: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict, status after the gate, and the ids of failing and warned rules in order."""
    blocking = (F.col("outcome") == FAIL) & (F.col("severity") == "error")
    ids = lambda o: F.array_join(F.array_sort(F.collect_list(F.when(F.col("outcome") == o, F.col("rule_id")))), ",")
    out = results.groupBy(*keys).agg(F.bool_or(blocking).alias("blocked"), ids(FAIL).alias("failing"), ids(WARN).alias("warned"))
    verdict = F.when(F.col("blocked"), FAIL).otherwise(PASS)
    return out.select(*keys, verdict.alias("verdict"), F.when(F.col("blocked"), "quarantined").otherwise("published").alias("status"), "failing", "warned")
