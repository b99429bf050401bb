"""Queries of the publication gate over all eighteen rules, with the SQL they are held against."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight import workers
from gatelight.operators import revalidation, rules, store

from . import spec
from .registry import query
from .sheet import SHEET

_PCT = "printf('%.{0}f', round({1} * 100, {0})) || '%'"


def _pct(c: str, places: int = 0) -> str:
    return _PCT.format(places, c)


_AREA = "greatest(least({2}, {6}) - greatest({0}, {4}), 0) * greatest(least({3}, {7}) - greatest({1}, {5}), 0) / (({2} - {0}) * ({3} - {1}))"


def _inside(core: tuple[str, ...], zone: tuple[str, ...]) -> str:
    return _AREA.format(*core, *zone)


_CORE = ("c1", "c2", "c3", "c4")

#: Every rule as a branch of its own: outcome, severity of a failure, expected and actual text.
RULES = f"""
with m as (select v.* exclude (sharpness), p.kind, p.width as want_w, p.height as want_h, p.ratio, p.min_sharpness, p.safe_x1, p.safe_y1, p.safe_x2, p.safe_y2,
    cast(split_part(p.ratio, ':', 1) as double) / cast(split_part(p.ratio, ':', 2) as double) as ratio_value, case p.kind when 'video' then 120 else 8 end as max_mb
  from {{v_media}} v join {{v_profiles}} p using (profile_id)),
seen as (select *, last_value(case when faces > 0 then t end ignore nulls) over (partition by media_id order by sample) as last_seen from {{v_samples}}),
s as (select media_id, count(*) as samples, count(*) filter (where faces > 0) as with_face, max(letterbox) as letterbox, avg(luma) as luma,
    case when count(*) > 2 then quantile_cont(sharpness, 0.5) else max(sharpness) end as sharp, count(*) filter (where faces > 0) / count(*) as coverage,
    coalesce(max(case when faces = 0 then t - last_seen end), 0) as gap from seen group by media_id),
f0 as (select f.*, m.profile_id, m.width as fw, m.height as fh, safe_x1 * m.width as s1, safe_y1 * m.height as s2, safe_x2 * m.width as s3, safe_y2 * m.height as s4,
    x1 + 0.15 * (x2 - x1) as c1, y1 + 0.15 * (y2 - y1) as c2, x2 - 0.15 * (x2 - x1) as c3, y2 - 0.15 * (y2 - y1) as c4,
    x1 - 0.18 * (x2 - x1) as h1, y1 - 0.38 * (y2 - y1) as h2, x2 + 0.18 * (x2 - x1) as h3, y2 + 0.20 * (y2 - y1) as h4,
    (y2 - y1 >= 0.45 * max(y2 - y1) over (partition by f.media_id, sample) or y2 - y1 >= 0.055 * m.height) as subject
  from {{v_media_faces}} f join m on f.media_id = m.media_id),
f as (select *, {_inside(_CORE, ("0", "0", "fw", "fh"))} as inside, {_inside(("h1", "h2", "h3", "h4"), ("0", "0", "fw", "fh"))} as head, {_inside(_CORE, ("s1", "s2", "s3", "s4"))} as safe from f0),
z as (select f.media_id, count(*) as n_reserved from f join {{v_reserved_zones}} z on f.profile_id = z.profile_id
  where subject and {_inside(_CORE, ("zx1 * fw", "zy1 * fh", "zx2 * fw", "zy2 * fh"))} > 0.12 group by f.media_id),
g as (select media_id, count(*) as faces, count(*) filter (where subject) as subjects, count(*) filter (where inside < 0.995 and inside > 0.02 and subject) as n_clipped,
    count(*) filter (where inside < 0.995 and inside > 0.02 and not subject) as n_extra, count(*) filter (where inside >= 0.995 and subject and head < 0.90) as n_tight,
    count(*) filter (where subject and safe < 0.97) as n_safe, min(inside) filter (where inside < 0.995 and inside > 0.02 and subject) as worst from f group by media_id),
a as (select m.*, s.* exclude (media_id), h.* exclude (media_id), coalesce(g.faces, 0) as faces, coalesce(subjects, 0) as subjects, coalesce(n_clipped, 0) as n_clipped, coalesce(n_extra, 0) as n_extra,
    coalesce(n_tight, 0) as n_tight, coalesce(n_safe, 0) as n_safe, coalesce(n_reserved, 0) as n_reserved, worst, coalesce(n_safe, 0) / greatest(coalesce(subjects, 0), 1) as safe_rate,
    coalesce(n_reserved, 0) / greatest(coalesce(subjects, 0), 1) as zone_rate, (subject_motion is null or subject_motion > 0.02) as moved
  from m left join s using (media_id) left join g using (media_id) left join z using (media_id) left join {{v_hints}} h using (media_id)),
results as (
  select media_id, 'tech.dimensions' as rule_id, case when width = want_w and height = want_h then 'pass' else 'fail' end as outcome, 'error' as level, want_w || 'x' || want_h as expected, width || 'x' || height as actual from a
  union all select media_id, 'tech.aspect_ratio', case when abs(width / height::double - ratio_value) / ratio_value <= 0.012 then 'pass' else 'fail' end, 'error', ratio, printf('%.4f', round(width / height::double, 4)) from a
  union all select media_id, 'tech.container_codec', case when (container like '%mp4%' or container in ('mp4', 'mov')) and lower(video_codec) = 'h264' and coalesce(pix_fmt, 'yuv420p') = 'yuv420p' then 'pass' else 'fail' end, 'error', 'mp4/h264/yuv420p', container || '/' || lower(video_codec) || '/' || coalesce(pix_fmt, 'unknown') from a where kind = 'video'
  union all select media_id, 'tech.audio', case when audio_codec is null or lower(audio_codec) <> 'aac' or audio_channels <> 2 or coalesce(audio_rate, 48000) <> 48000 then 'fail' else 'pass' end, 'error', case when audio_codec is null then 'aac' else 'aac/2ch/48000Hz' end,
    case when audio_codec is null then 'none' else audio_codec || '/' || audio_channels || 'ch/' || coalesce(audio_rate, 0) || 'Hz' end from a where kind = 'video'
  union all select media_id, 'tech.frame_rate', case when fps is null then 'warn' when fps between 23 and 61 then 'pass' else 'fail' end, 'error', '23.0-61.0 fps', coalesce(printf('%.2f fps', round(fps, 2)), 'unknown') from a where profile_id = 'reel_vertical_9x16'
  union all select media_id, 'tech.duration', case when duration_s is null then 'warn' when duration_s between 3 and 90 then 'pass' else 'fail' end, 'error', '3.0-90.0s', coalesce(printf('%.2fs', round(duration_s, 2)), 'unknown') from a where profile_id = 'reel_vertical_9x16'
  union all select media_id, 'tech.bitrate', case when bitrate_kbps is null then 'warn' when bitrate_kbps between 1500 and 14000 then 'pass' else 'warn' end, 'warning', '1500.0-14000.0 kbps', coalesce(printf('%.0f kbps', round(bitrate_kbps, 0)), 'unknown') from a where profile_id = 'reel_vertical_9x16'
  union all select media_id, 'tech.file_size', case when size_bytes > max_mb * 1048576 then 'fail' else 'pass' end, 'error', '<= ' || max_mb || ' MB', printf('%.2f MB', round(size_bytes / 1048576.0::double, 2)) from a
  union all select media_id, 'quality.letterbox', case when samples is null then 'skip' when letterbox > 0.01 then 'fail' else 'pass' end, 'error', case when samples > 0 then '<= 1.0%' end, case when samples > 0 then {_pct("letterbox", 2)} end from a
  union all select media_id, 'quality.sharpness', case when samples is null then 'skip' when sharp < min_sharpness then 'fail' else 'pass' end, 'error', case when samples > 0 then '>= ' || printf('%.0f', min_sharpness) end, case when samples > 0 then printf('%.1f', round(sharp, 1)) end from a
  union all select media_id, 'quality.luminance', case when samples is null then 'skip' when luma between 22 and 238 then 'pass' else 'warn' end, 'warning', case when samples > 0 then '22.0-238.0' end, case when samples > 0 then printf('%.1f', round(luma, 1)) end from a
  union all select media_id, 'subject.face_integrity', case when samples is null then 'skip' when n_clipped > 0 then 'fail' when faces = 0 then 'skip' when n_extra > 0 or n_tight > 0 then 'warn' else 'pass' end, 'error',
    case when samples > 0 and faces > 0 then case when n_clipped > 0 then '>= 99.5% of every subject kept' when n_extra > 0 then 'all subjects whole' when n_tight > 0 then 'all faces whole' else 'all subjects whole' end end,
    case when samples > 0 and faces > 0 then case when n_clipped > 0 then {_pct("worst", 1)} || ' is the least kept' when n_extra > 0 then 'other faces cut' when n_tight > 0 then 'little room round a head' else 'none' end end from a
  union all select media_id, 'subject.presence', case when samples is null or not coalesce(source_has_faces, false) then 'skip' when kind = 'image' then case when with_face > 0 then 'pass' else 'fail' end when round(gap, 6) > 1.5 or coverage < 0.70 then 'fail' else 'pass' end, 'error',
    case when samples > 0 and source_has_faces then case when kind = 'image' then 'subject present' when round(gap, 6) > 1.5 then 'no absence longer than 1.5s' when coverage < 0.70 then '>= 70%' else '>= 70%, no gap over 1.5s' end end,
    case when samples > 0 and source_has_faces then case when kind = 'image' then case when with_face > 0 then 'present' else 'absent' end when round(gap, 6) > 1.5 then printf('%.2fs', round(gap, 2)) else {_pct("coverage", 1)} end end from a
  union all select media_id, 'subject.safe_zone', case when subjects = 0 then 'skip' when safe_rate <= 0.05 then 'pass' when safe_rate <= 0.20 then 'warn' else 'fail' end, 'error',
    case when subjects > 0 then 'subjects inside the safe area' end, case when subjects > 0 then case when safe_rate <= 0.05 then 'within' else {_pct("safe_rate")} || ' outside' end end from a
  union all select media_id, 'subject.reserved_zone', case when subjects = 0 then 'skip' when zone_rate <= 0.05 then 'pass' when zone_rate <= 0.20 then 'warn' else 'fail' end, 'error',
    case when subjects > 0 then 'reserved zones free of faces' end, case when subjects > 0 then case when zone_rate <= 0.05 then 'clear' else {_pct("zone_rate")} || ' overlapping' end end from a where profile_id in (select profile_id from {{v_reserved_zones}})
  union all select media_id, 'subject.reframe_motion', case when moving_fraction is null then 'skip' when moved and (1 - moving_fraction >= 0.95 or total_travel < 0.01) then 'fail' else 'pass' end, 'error',
    case when moving_fraction is not null then case when moved and 1 - moving_fraction >= 0.95 then 'movement in over 5% of frames' else 'the crop goes along' end end,
    case when moving_fraction is not null then case when moved and 1 - moving_fraction >= 0.95 then 'moves in ' || {_pct("moving_fraction", 1)} when moved and total_travel < 0.01 then 'hardly any travel' when not moved then 'nothing to follow' else 'moving in ' || {_pct("moving_fraction", 1)} || ' of frames' end end from a where kind = 'video'
  union all select media_id, 'subject.active_speaker', case when speaker_coverage is null or speech_steps = 0 then 'skip' when speaker_coverage < 0.80 then 'fail' else 'pass' end, 'error',
    case when speaker_coverage is not null and speech_steps > 0 then '>= 80% of speech time' end, case when speaker_coverage is not null and speech_steps > 0 then {_pct("speaker_coverage", 1)} end from a where kind = 'video'
  union all select media_id, 'subject.crop_provenance', case when subject_offset is null or crop_offset is null then 'skip' when subject_offset > 0.04 and crop_offset < 0.01 then 'warn' else 'pass' end, 'warning',
    case when subject_offset is not null and crop_offset is not null then 'crop and subject off centre alike' end,
    case when subject_offset is not null and crop_offset is not null then case when subject_offset > 0.04 and crop_offset < 0.01 then 'centred crop of an off-centre subject' when subject_offset <= 0.04 then 'subject in the middle' else 'crop offset ' || {_pct("crop_offset", 1)} end end from a),
rated as (select media_id, rule_id, outcome, case outcome when 'fail' then level when 'warn' then 'warning' else 'info' end as severity, expected, actual from results)
"""


def facts(t, evidence: bool = True, sheet: dict = SHEET) -> DataFrame:
    sheet = spec.profile_table(t._spark, sheet)
    return rules.gathered(t.v_media.drop("sharpness"), sheet, t.v_samples, t.v_media_faces, t.v_hints, evidence=evidence)


def results(t, *details: str) -> DataFrame:
    """Every rule's outcome and severity, with the ``details`` asked for."""
    df = facts(t, "evidence" in details)
    return rules.evaluate(df, ["media_id"], rules.all_rules(df.columns), details)


@query(RULES + "select * from rated")
def rule_results(t):
    return results(t, "expected", "actual")


@query(RULES + """select media_id, case when bool_or(outcome = 'fail' and severity = 'error') then 'fail' else 'pass' end as verdict,
  case when bool_or(outcome = 'fail' and severity = 'error') then 'quarantined' else 'published' end as status,
  coalesce(string_agg(rule_id, ',' order by rule_id) filter (where outcome = 'fail'), '') as failing,
  coalesce(string_agg(rule_id, ',' order by rule_id) filter (where outcome = 'warn'), '') as warned from rated group by media_id""")
def gate_verdict(t):
    return rules.gate(results(t), ["media_id"])


@query(RULES + """select media_id, count(*) filter (where outcome = 'pass') as n_pass, count(*) filter (where outcome = 'warn') as n_warn,
  count(*) filter (where outcome = 'fail') as n_fail, count(*) filter (where outcome = 'skip') as n_skip from rated group by media_id""")
def report_summary(t):
    return rules.summary(results(t), ["media_id"])


@query(RULES + """select media_id, rule_id, outcome, (row_number() over (partition by media_id order by case outcome when 'fail' then 0 when 'warn' then 1 when 'pass' then 2 else 3 end, rule_id))::int as place from rated""")
def report_order(t):
    return rules.display_order(results(t), ["media_id"]).select("media_id", "rule_id", "outcome", "place")


@query(RULES + """, e as (select f.media_id, sample, face_no, round(safe, 4) as share, row_number() over (partition by f.media_id order by sample, face_no) as nth, count(*) over (partition by f.media_id) as n from f where subject and safe < 0.97)
select media_id, n, string_agg(sample || '.' || face_no, ' ' order by nth) as first_twelve from e where nth <= 12 group by media_id, n""")
def safe_zone_evidence(t):
    """The first twelve offences against the action-safe area beside the count of all."""
    listed = F.array_join(F.transform("first_safe", lambda o: F.concat_ws(".", o["sample"].cast("string"), o["face_no"].cast("string"))), " ")
    return facts(t).filter("n_safe > 0").select("media_id", F.col("n_safe").alias("n"), listed.alias("first_twelve"))


@query(RULES + """, d as (select media_id, bool_or(outcome = 'fail' and severity = 'error') as b, coalesce(string_agg(rule_id, ',' order by rule_id) filter (where outcome = 'fail'), '') as f,
    coalesce(string_agg(rule_id, ',' order by rule_id) filter (where outcome = 'warn'), '') as w from rated group by media_id)
select media_id, 'variant.' || case when b then 'quarantined' else 'published' end as action, case when b then 'failure' else 'success' end as outcome,
  '{"failing":"' || f || '","warned":"' || w || '"}' as detail from d""")
def decision_audit(t):
    return store.decision_audit(rules.gate(results(t), ["media_id"]), "media_id")


@query("""select m.media_id, p.profile_id, p.kind, case p.kind when 'video' then 120 else 8 end::double as max_mb, p.min_sharpness,
  case when p.profile_id = 'reel_vertical_9x16' then 23.0::double end as fps_lo, case when p.profile_id = 'reel_vertical_9x16' then 61.0::double end as fps_hi,
  0.995::double as clip_tolerance, 0.8::double as min_speaker, 22.0::double as luma_lo from {v_media} m join {v_profiles} p using (profile_id)""")
def settings_merge(t):
    """The limits each medium is held to: built in, the sheet's defaults and its profile's overrides, merged from the sheet itself."""
    merged = rules.with_profile(t.v_media.select("media_id", "profile_id"), spec.profile_table(t._spark, SHEET))
    return merged.select("media_id", "profile_id", "kind", "max_mb", "min_sharpness", "fps_lo", "fps_hi", "clip_tolerance", "min_speaker", "luma_lo")


def newer_sheet() -> dict:
    """The sheet's next version: images may be larger and must be sharper."""
    sheet = copy.deepcopy(SHEET)
    sheet["defaults"]["image"] |= {"max_file_size_mb": 160, "min_sharpness": 55.0}
    return sheet


_NEWER = RULES.replace("then 120 else 8 end as max_mb", "then 120 else 160 end as max_mb").replace("p.ratio, p.min_sharpness,", "p.ratio, case p.min_sharpness when 45 then 55 else p.min_sharpness end as min_sharpness,")


@query(f"""select media_id, case when o.b then 'fail' else 'pass' end as old_verdict, case when n.b then 'fail' else 'pass' end as new_verdict, rules from (
  select media_id, bool_or(coalesce(o.outcome = 'fail' and o.severity = 'error', false)) as ob, bool_or(coalesce(n.outcome = 'fail' and n.severity = 'error', false)) as nb,
    coalesce(string_agg(rule_id, ',' order by rule_id) filter (where o.outcome is distinct from n.outcome), '') as rules
  from ({RULES} select * from rated) o full join ({_NEWER} select * from rated) n using (media_id, rule_id) group by media_id) x, lateral (select ob as b) o, lateral (select nb as b) n where ob <> nb""")
def revalidation_flips(t):
    """Media whose verdict another version of the sheet turns; only rules whose limits it changes are judged again."""
    old, new = (spec.profile_table(t._spark, s) for s in (SHEET, newer_sheet()))
    held = facts(t, False)
    held.write.parquet(path := f"{workers.shared_folder(t._spark)}/facts")  # measured once, for both sheets
    held = t._spark.read.schema(held.schema).parquet(path)
    now = rules.under_sheet(held, old, new)
    judged = rules.evaluate(held, ["media_id"], rules.all_rules(held.columns), ())
    return revalidation.flips(revalidation.revalidate(facts(t, False, newer_sheet()) if now is None else now, judged, old, new, rules.all_rules))


_VERSIONS = [(v, at) for v, at in ((1, "2024-01-01"), (2, "2024-01-09"), (3, "2024-01-21"))]


@query("""with v as (select *, lead(valid_from) over (order by valid_from) as valid_to from (values (1, timestamp '2024-01-01'), (2, timestamp '2024-01-09'), (3, timestamp '2024-01-21')) v(version, valid_from))
select id, version from {v_audit} a left join v on a.at >= valid_from and (valid_to is null or a.at < valid_to) where action in ('variant.published', 'variant.quarantined')""")
def decision_sheets(t):
    """The version of the sheet each decision was made by."""
    profiles = t.v_profiles.select("profile_id", F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(d).cast("timestamp_ntz").alias("valid_from")) for v, d in _VERSIONS])).alias("v")).select("profile_id", "v.*")
    ids = F.array(*[F.lit(p) for p in ("hero_landscape_16x9", "social_square_1x1", "story_vertical_9x16", "feed_portrait_4x5", "reel_vertical_9x16", "video_still_16x9")])
    decisions = t.v_audit.filter(F.col("action").isin("variant.published", "variant.quarantined")).select("id", F.col("at").alias("decided_at"), F.element_at(ids, F.col("profile_no") + 1).alias("profile_id"))
    return revalidation.decided_by(decisions, profiles).select("id", "version")


@query(RULES + """, e as (select f.media_id, min(sample) filter (where subject and safe < 0.97) as first_safe from f group by f.media_id)
select media_id, rule_id, faces::int as faces, subjects::int as subjects, case rule_id when 'subject.safe_zone' then n_safe when 'subject.face_integrity' then n_clipped end::int as n,
  case when rule_id = 'subject.safe_zone' then first_safe end as first_sample
from (select media_id, rule_id from rated where rule_id in ('subject.safe_zone', 'subject.face_integrity')) r join (select media_id, subjects as s, n_safe, n_clipped, nullif(subjects, 0) as _, faces, subjects from a) a using (media_id)
left join e using (media_id) where faces > 0""")
def evidence_paths(t):
    """Evidence as VARIANT, asked by path."""
    from gatelight.operators.evidence import paths

    held = results(t, "evidence").filter(F.col("rule_id").isin("subject.safe_zone", "subject.face_integrity"))
    own = F.when(F.col("rule_id") == "subject.safe_zone", F.col("n_safe")).otherwise(F.col("n_clipped"))
    asked = paths(held, faces="$.faces int", subjects="$.subjects int", n_safe="$.n_safe int", n_clipped="$.n_clipped int", first_sample="$.first_safe[0].sample int")
    return asked.filter("faces > 0").select("media_id", "rule_id", "faces", "subjects", own.alias("n"), "first_sample")


@query("""with r as (select * from (values ('image', 'hero_landscape_16x9'), ('image', 'social_square_1x1'), ('image', 'story_vertical_9x16'), ('image', 'feed_portrait_4x5'), ('video', 'reel_vertical_9x16'), ('video', 'video_still_16x9')) r(kind, profile_id))
select a.asset_id, r.profile_id from {v_assets} a join r using (kind)""")
def render_plan(t):
    """The profiles each asset is rendered to, by the render set of its kind."""
    return t.v_assets.join(F.broadcast(spec.render_table(t._spark, SHEET)), "kind").select("asset_id", "profile_id")
