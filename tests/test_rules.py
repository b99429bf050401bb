import pytest
from gatelight.operators import rules
from gatelight.plans import spec
from pyspark.sql import functions as F

SHEET = {"profiles": [
    {"id": "reel", "ratio": "9:16", "kind": "video", "width": 1080, "height": 1920, "fps_range": [23, 61], "duration_range_s": [3, 90], "bitrate_kbps_range": [1500, 14000], "overrides": {"max_file_size_mb": 50}},
    {"id": "still", "ratio": "4:5", "kind": "image", "width": 1080, "height": 1350, "safe_zones": {"action": [0.05, 0.06, 0.95, 0.94]}, "reserved_zones": [{"name": "top", "rect": [0, 0, 1, 0.12]}]},
], "defaults": {"image": {"luma_mean_range": [22, 238]}, "video": {"max_file_size_mb": 120}}}
GOOD = {"id": 1, "profile_id": "reel", "width": 1080, "height": 1920, "container": "mov,mp4", "video_codec": "h264", "pix_fmt": "yuv420p", "audio_codec": "aac", "audio_channels": 2, "audio_rate": 48000, "fps": 30.0,
        "duration_s": 30.0, "bitrate_kbps": 5000.0, "size_bytes": 10_000_000, "letterbox": 0.0, "sharpness": 12.0, "luma": 120.0}
SCHEMA = "id long, profile_id string, width int, height int, container string, video_codec string, pix_fmt string, audio_codec string, audio_channels int, audio_rate int, fps double, duration_s double, bitrate_kbps double, size_bytes long, letterbox double, sharpness double, luma double"


def outcomes(spark, **changes):
    row = GOOD | changes
    df = rules.with_profile(spark.createDataFrame([tuple(row.values())], SCHEMA), spec.profile_table(spark, SHEET))
    results = rules.evaluate(df, ["id"], rules.technical_rules(df.columns))
    found = {r.rule_id: (r.outcome, r.severity) for r in results.collect()}
    return found, rules.gate(results, ["id"]).first()


def test_all_pass(spark):
    found, gate = outcomes(spark)
    assert len(found) == 11 and {o for o, _ in found.values()} == {"pass"} and gate.status == "published"


@pytest.mark.parametrize("changes, rule, outcome, status", [
    ({"width": 1000}, "tech.dimensions", "fail", "quarantined"),
    ({"height": 0}, "tech.aspect_ratio", "fail", "quarantined"),
    ({"container": "webm"}, "tech.container_codec", "fail", "quarantined"),
    ({"pix_fmt": None}, "tech.container_codec", "pass", "published"),
    ({"audio_codec": None}, "tech.audio", "fail", "quarantined"),
    ({"audio_channels": None}, "tech.audio", "pass", "published"),
    ({"fps": None}, "tech.frame_rate", "warn", "published"),
    ({"fps": 61.0}, "tech.frame_rate", "pass", "published"),
    ({"duration_s": 90.1}, "tech.duration", "fail", "quarantined"),
    ({"bitrate_kbps": 100.0}, "tech.bitrate", "warn", "published"),
    ({"size_bytes": 50 * 1024 * 1024 + 1}, "tech.file_size", "fail", "quarantined"),
    ({"letterbox": None}, "quality.letterbox", "skip", "published"),
    ({"sharpness": 5.9}, "quality.sharpness", "fail", "quarantined"),
    ({"luma": 10.0}, "quality.luminance", "warn", "published"),
])
def test_one_fault(spark, changes, rule, outcome, status):
    found, gate = outcomes(spark, **changes)
    assert found[rule][0] == outcome and gate.status == status


def test_rules_that_do_not_apply_emit_no_row(spark):
    found, _ = outcomes(spark, profile_id="still")
    assert not {"tech.audio", "tech.frame_rate", "tech.duration", "tech.bitrate", "tech.container_codec"} & set(found)


def test_summary_is_zero_filled(spark):
    df = spark.createDataFrame([(1, "pass"), (1, "pass"), (2, "fail")], "id long, outcome string")
    assert sorted(map(tuple, rules.summary(df, ["id"]).collect())) == [(1, 2, 0, 0, 0), (2, 0, 0, 1, 0)]


def test_hint_rules(spark):
    rows = [("reel", 0.01, 0.5, 0.3, 0.9, 5, 0.0, 0.0), ("reel", 0.01, 0.5, 0.01, 0.5, 5, 0.1, 0.0), ("reel", None, None, None, None, None, None, None), ("still", 0.01, 0.0, 0.3, 0.1, 5, 0.1, 0.5), ("reel", 0.5, 0.001, None, 0.1, 0, 0.1, 0.02)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, profile_id string, moving_fraction double, total_travel double, subject_motion double, speaker_coverage double, speech_steps int, subject_offset double, crop_offset double")
    found = {}
    for r in rules.evaluate(rules.with_profile(df, spec.profile_table(spark, SHEET)), ["id"], rules.hint_rules()).collect():
        found.setdefault(r.id, {})[r.rule_id.split(".")[1]] = r.outcome
    assert found[0] == {"reframe_motion": "fail", "active_speaker": "pass", "crop_provenance": "pass"}
    assert found[1] == {"reframe_motion": "pass", "active_speaker": "fail", "crop_provenance": "warn"}
    assert set(found[2].values()) == {"skip"}
    assert found[3] == {"crop_provenance": "pass"}
    assert found[4] == {"reframe_motion": "fail", "active_speaker": "skip", "crop_provenance": "pass"}


def test_limits_come_from_the_sheet(spark):
    from gatelight.operators.rules import FAIL

    loose = {**SHEET, "profiles": [{**SHEET["profiles"][0], "overrides": {"max_file_size_mb": 200, "min_sharpness": 50}}]}
    df = spark.createDataFrame([tuple((GOOD | {"size_bytes": 100 * 1024 * 1024}).values())], SCHEMA)
    for sheet, size, sharp in ((SHEET, FAIL, "pass"), (loose, "pass", FAIL)):
        rows = {r.rule_id: r for r in rules.evaluate(*(lambda d: (d, ["id"], rules.technical_rules(d.columns)))(rules.with_profile(df, spec.profile_table(spark, sheet)))).collect()}
        assert rows["tech.file_size"].outcome == size and rows["quality.sharpness"].outcome == sharp
    assert rows["tech.file_size"].expected == "<= 200 MB" and rows["tech.file_size"].actual == "100.00 MB"


def test_evidence_lists_twelve_and_counts_all(spark):
    media = spark.createDataFrame([(1, "still", 1080, 1350), (2, "still", 1080, 1350)], "media_id long, profile_id string, width int, height int")
    faces = spark.createDataFrame([(1, s, s * 0.5, 1, 100.0, -60.0, 300.0, 140.0) for s in range(20)], "media_id long, sample int, t double, face_no int, x1 double, y1 double, x2 double, y2 double")
    samples = spark.createDataFrame([(1, s, s * 0.5, 1, 0.0, 100.0, 60.0) for s in range(20)], "media_id long, sample int, t double, faces long, letterbox double, luma double, sharpness double")
    hints = spark.createDataFrame([(1, True, None, None, None, None, None, None, None)], "media_id long, source_has_faces boolean, moving_fraction double, total_travel double, subject_motion double, speaker_coverage double, speech_steps int, subject_offset double, crop_offset double")
    df = rules.gathered(media, spec.profile_table(spark, SHEET), samples, faces, hints)
    row = df.filter("media_id = 1").first()
    assert (row.n_clipped, len(row.first_clipped), [o["sample"] for o in row.first_clipped]) == (20, 12, list(range(12)))
    assert row.n_safe == 20 and row.n_reserved == 20 and row.first_reserved[0]["zone"] == "top"
    out = {(r.media_id, r.rule_id): r for r in rules.evaluate(df, ["media_id"], [*rules.subject_rules(), *rules.hint_rules()]).collect()}
    assert out[1, "subject.face_integrity"].outcome == "fail" and '"n_clipped":20' in out[1, "subject.face_integrity"].evidence
    assert out[1, "subject.presence"].outcome == "pass" and {r.outcome for (m, _), r in out.items() if m == 2} == {"skip"}


def test_a_rule_of_ones_own_and_one_that_cannot_be_judged(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id long, x int")
    own = rules.Rule("own.small", "error", F.lit(True), rules.ok_unless(F.col("x") > 3))
    broken = rules.Rule("own.null", "error", F.lit(True), F.when(F.col("x") > 3, "pass"))
    found = {(r.id, r.rule_id): (r.outcome, r.severity) for r in rules.evaluate(df, ["id"], [own, broken]).collect()}
    assert found == {(1, "own.small"): ("fail", "error"), (2, "own.small"): ("pass", "info"), (1, "own.null"): ("pass", "info"), (2, "own.null"): ("fail", "error")}


def test_plans_hold_only_what_is_read(spark, sf_dir):
    """No text or evidence is made for queries that read outcomes alone, and evidence is limited before its shuffle."""
    from gatelight.plans import gate, views

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    t = views.Tables(spark, sf_dir)
    for q in (gate.report_summary, gate.gate_verdict, gate.report_order, gate.decision_audit):
        assert not any(x in plan(q(t)) for x in ("first_safe", "format_string")), q
        assert q is gate.decision_audit or "to_json" not in plan(q(t)).lower()  # the audit writes JSON of its own
    full = plan(gate.results(t, "expected", "actual", "evidence"))
    assert "first_safe" in full and "WindowGroupLimit" in full


def test_faces_are_ranked_in_their_frame_without_the_limits_of_their_profile(spark):
    """Sorted by frame are a face's own columns alone, and a face is worked out once: no join carries what the lists of offences hold."""
    faces = spark.createDataFrame([(1, 1, 0.4, 1, 0.0, 0.0, 100.0, 200.0)], "media_id long, sample int, t double, face_no int, x1 double, y1 double, x2 double, y2 double")
    media = rules.with_profile(spark.createDataFrame([(1, "still", 1080, 1350)], "media_id long, profile_id string, width int, height int"), spec.profile_table(spark, SHEET))
    plan = rules.face_facts(faces, media)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    tops = [i for i, line in enumerate(plan) if "Window [max(" in line]
    assert len(tops) == 2
    for i in tops:
        below = next((k for k in range(i + 1, len(plan)) if depth(plan[k]) <= depth(plan[i])), len(plan))
        assert not any("Join" in line or "reserved" in line for line in plan[i:below])
    assert not any("Join" in line and "filter(transform(" in line for line in plan)
