"""Queries over clips: speakers, shots, smoothing, spans, stills and framing, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelight.functions import boxes, tables
from gatelight.operators import crop, folds, framing, sequences, speakers, tracking

from .registry import query

CLIP_W, CLIP_H = 1280.0, 720.0
FRAME_W, FRAME_H = 1080.0, 1920.0


def _r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


@query("""with recursive s as materialized (select clip_id, i, speech as q, sum(low_corr::int) over (partition by clip_id order by i)::int as shot from {v_steps}),
b as materialized (select clip_id, i, max(score) as best, arg_max(track, (score, -track)) as c from {v_track_scores} where present group by clip_id, i),
p as materialized (select s.*, b.best, b.c from s left join b using (clip_id, i)),
f as (select clip_id, i, shot, case when q < 0.25 or best is null or best < 0.30 then -1 else c end as active, case when q < 0.25 or best is null or best < 0.30 then 1 else 0 end as dwell from p where i = 0
  union all
  select clip_id, i, shot, case when change then c else a end, case when change then 0 else d + 1 end from (
    select n.*, not (n.q < 0.25 or n.best is null or n.best < 0.30) and (n.a = -1 or (n.c <> n.a and n.best >= coalesce(v.score, 0) + 0.22 and n.d >= 12)) as change
    from (select p.*, case when p.shot <> f.shot then -1 else f.active end as a, case when p.shot <> f.shot then 0 else f.dwell end as d from f join p on p.clip_id = f.clip_id and p.i = f.i + 1) n
    left join {v_track_scores} v on v.clip_id = n.clip_id and v.i = n.i and v.track = n.a and v.present) m)
select clip_id, i, active::int as active, dwell::int as dwell from f""")
def speaker_resolve(t):
    """The speaker per step from the scores of all present tracks, with the margin over the incumbent's own score."""
    found = t.v_track_scores.filter("present").groupBy("clip_id", "i").agg(F.map_from_entries(F.collect_list(F.struct("track", "score"))).alias("scores"))
    steps = sequences.shot_ids(t.v_steps, "low_corr").join(found, ["clip_id", "i"], "left")
    return folds.resolve(steps, "clip_id", "scores", "speech", "shot_id")


@query("""with recursive s as materialized (select clip_id, i, 1 - speech * low_corr::int as v from {v_steps}),
f as (select clip_id, i, 0 as shot, 1 as frames, [v] as seen, false as cut from s where i = 0
  union all
  select clip_id, i, shot + cut::int, case when cut then 0 else frames end + 1, case when cut then [] when len(seen) >= 60 then list_append(seen[2:], v) else list_append(seen, v) end, cut
  from (select s.clip_id, s.i, s.v, f.shot, f.frames, f.seen, s.v < case when len(f.seen) < 8 then 0.70 else least(0.92, list_aggregate(f.seen, 'median') - 0.10) end and f.frames >= 3 as cut
    from f join s on s.clip_id = f.clip_id and s.i = f.i + 1) n)
select clip_id, i, shot as shot_id, cut as is_cut from f""")
def shot_state(t):
    return folds.shot_state(t.v_steps.withColumn("corr", 1 - F.col("speech") * F.col("low_corr").cast("int")), "clip_id", "corr")


def _spring(name: str, source: str) -> str:
    """Recursive term: ``name`` follows the targets of ``source`` (clip_id, i, t, cx, cy, w, h, shot, active)."""
    pi2 = "2 * pi()"
    go = "{0} + (({1} - {0}) + (v{1} + {2} * ({1} - {0})) * dt) * exp(-{2} * dt)"
    speed = "(v{1} - {2} * (v{1} + {2} * ({1} - {0})) * dt) * exp(-{2} * dt)"
    axes = (("cx", "x", "omega"), ("cy", "y", "omega"), ("tw", "w", f"({pi2} * 0.55)"))
    moved = ", ".join(f"case when snap then {g} when still then {p} + v{p} * bleed * dt else {go.format(g, p, o)} end as n{p}, case when snap then 0.0 when still then v{p} * bleed else {speed.format(g, p, o)} end as nv{p}" for g, p, o in axes)
    clamp = "greatest(wide / 2, least({x}, 1280 - wide / 2)) as x, greatest(tall / 2, least({y}, 720 - tall / 2)) as y, wide as w"
    return f"""{name} as (
  select clip_id, i, t, {clamp.format(x="cx", y="cy")}, 0.0::double as vx, 0.0::double as vy, 0.0::double as vw, 0.0::double as timer, shot, active as track
  from (select *, greatest(16.0, least(1280.0, w)) as wide, least(greatest(16.0, least(1280.0, w)) / (w / h), 720.0) as tall from {source} where i = 0) z
  union all
  select clip_id, i, t, {clamp.format(x="nx", y="ny")}, nvx * brake, nvy * brake, nvw, case when snap then 0.0 when easing then greatest(0.0, timer0 - dt) else timer0 end, shot, case when snap or switched then active else track end
  from (select *, least(wide / (tw / h), 720.0) as tall, case when not snap and not still and sqrt(nvx * nvx + nvy * nvy) > 0.85 * 1280 * case when easing then 2.2 else 1.0 end
      then 0.85 * 1280 * case when easing then 2.2 else 1.0 end / sqrt(nvx * nvx + nvy * nvy) else 1.0 end as brake
    from (select *, greatest(16.0, least(1280.0, nw)) as wide from (select *, {moved}
      from (select *, not easing and away < 0.012 as still, case when easing then {pi2} * 4.2 else {pi2} * 1.1 end as omega, greatest(0.0, 1 - 6 * dt) as bleed
        from (select *, timer0 > 0 as easing, sqrt(pow((cx - x) / 1280, 2) + pow((cy - y) / 720, 2)) as away
          from (select s.clip_id, s.i, s.t, s.cx, s.cy, s.w as tw, s.h, s.shot, s.active, f.x, f.y, f.w, f.vx, f.vy, f.vw, f.track, greatest(1e-3, least(0.25, s.t - f.t)) as dt, s.shot <> f.shot as snap,
              s.active is not null and s.active is distinct from f.track as switched, case when s.active is not null and s.active is distinct from f.track then 0.30 else f.timer end as timer0
            from {name} f join {source} s on s.clip_id = f.clip_id and s.i = f.i + 1) a) b) c) d) e) g)"""


_FOLLOWED = """with recursive s as materialized (select clip_id, i, t, cx, cy, 405.0::double as w, 720.0::double as h, sum(low_corr::int) over (partition by clip_id order by i)::int as shot,
  case when seen then candidate_track end as active from {v_steps}), """ + _spring("f", "s")


def _targets(t):
    steps = sequences.shot_ids(t.v_steps, "low_corr")
    return steps.select("clip_id", "i", "t", "cx", "cy", F.lit(405.0).alias("w"), F.lit(720.0).alias("h"), "shot_id", F.when(F.col("seen"), F.col("candidate_track")).alias("active_track"))


@query(_FOLLOWED + " select clip_id, i, round(x, 6) as cx, round(y, 6) as cy, round(w, 6) as w from f")
def spring_smooth(t):
    return folds.spring_smooth(_targets(t), "clip_id", CLIP_W, CLIP_H).select("clip_id", "i", *[_r6(c).alias(c) for c in ("cx", "cy", "w")])


@query(_FOLLOWED + """, r as materialized (select f.clip_id, (max(f.i) over (partition by f.clip_id) - f.i)::int as i, f.i as j, -f.t as t, f.x as cx, f.y as cy, f.w, s.h, s.shot, s.active from f join s using (clip_id, i)), """ + _spring("g", "r") + """
select r.clip_id, r.j as i, round((r.cx + g.x) / 2, 6) as cx, round((r.cy + g.y) / 2, 6) as cy, round((r.w + g.w) / 2, 6) as w from r join g using (clip_id, i)""")
def smooth_two_pass(t):
    """The follower run forward, then backward over its own output, and the mean of the two passes."""
    return folds.smooth_two_pass(_targets(t), "clip_id", CLIP_W, CLIP_H).select("clip_id", "i", *[_r6(c).alias(c) for c in ("cx", "cy", "w")])


_NMS = """with recursive o as materialized (select frame_id, face_no, conf, {'n': face_no, 'a': x1, 'b': y1, 'c': x2, 'd': y2, 'g': (x2 - x1) * (y2 - y1)} as x, row_number() over (partition by frame_id order by conf desc, face_no) as k from {v_faces}),
f as (select frame_id, k, [x] as kept, true as stays, face_no, conf from o where k = 1
  union all
  select frame_id, k, case when fine then list_append(kept, x) else kept end, fine, face_no, conf from (
    select o.frame_id, o.k, o.x, f.kept, o.face_no, o.conf, len(list_filter(f.kept, lambda p: greatest(least(p.c, o.x.c) - greatest(p.a, o.x.a), 0) * greatest(least(p.d, o.x.d) - greatest(p.b, o.x.b), 0)
        >= 0.35 * (p.g + o.x.g - greatest(least(p.c, o.x.c) - greatest(p.a, o.x.a), 0) * greatest(least(p.d, o.x.d) - greatest(p.b, o.x.b), 0))
      or greatest(least(p.c, o.x.c) - greatest(p.a, o.x.a), 0) * greatest(least(p.d, o.x.d) - greatest(p.b, o.x.b), 0) > 0.72 * o.x.g)) = 0 as fine
    from f join o on o.frame_id = f.frame_id and o.k = f.k + 1) n)
select frame_id, face_no, round(conf, 6) as conf from f where stays"""


@query(_NMS)
def nms(t):
    return folds.nms(t.v_faces).select("frame_id", "face_no", _r6("conf").alias("conf"))


_PASSES = """(select frame_id, face_no, conf, x1, y1, x2, y2 from {v_faces} where size_px >= 200
  union all select frame_id, 1000 + face_no, conf - 0.05::double, x1 + 4, y1 + 4, x2 + 4, y2 + 4 from {v_faces}) p"""


@query(_NMS.replace("from {v_faces}", f"from {_PASSES}").replace("select frame_id, face_no, round", "select frame_id, (face_no // 1000)::int as pass_no, (face_no % 1000)::int as face_no, round"))
def nms_passes(t):
    """Large faces from the whole frame, then all faces, a little off and less sure, from its tiles: each person stays once."""
    moved = t.v_faces.withColumns({"conf": F.col("conf") - 0.05, **{c: F.col(c) + 4 for c in ("x1", "y1", "x2", "y2")}})
    return folds.nms_passes([t.v_faces.filter("size_px >= 200"), moved]).select("frame_id", "pass_no", "face_no", _r6("conf").alias("conf"))


_REEL = """with s as (select clip_id, i, t, speech, case when seen then candidate_track else 0 end as faces, mouth / 3000 as largest, sum(low_corr::int) over (partition by clip_id order by i)::int as shot_id,
    coalesce((seen and candidate_track <> lag(candidate_track) over (partition by clip_id order by i))::int, 0) as churn, max(t) over (partition by clip_id) + 0.1 as duration from {v_steps}),
w as (select *, speech + case when faces > 0 then 0.45 + 0.70 * greatest(0, least(1, largest / 0.03)) - 0.60 * greatest(0, least(1, (faces - 2) / 4.0::double)) else 0 end
    - 1.20 * coalesce((shot_id <> lag(shot_id) over (partition by clip_id order by i))::int, 0) - 1.40 * churn as worth, t - lag(t) over (partition by clip_id order by i) as dt from s),
g as (select clip_id, count(*) as n, max(duration) as duration, quantile_cont(dt, 0.5) as pace from w group by clip_id),
r as (select w.* exclude (duration), g.n, g.duration, least(greatest(4, round_even(3.0 / g.pace, 0)::int), g.n)::int as wide from w join g using (clip_id)),
a as (select *, sum(worth) over q as total, last_value(t) over q as end_t, count(*) over q as held from r window q as (partition by clip_id order by i rows between current row and wide - 1 following)),
best as (select clip_id, arg_max(t, (round(total, 6), -i)) as w_start, arg_max(end_t, (round(total, 6), -i)) as w_end from a where held = wide group by clip_id),
h as (select clip_id, shot_id, max(t) - min(t) as span, count(*) as len, min(i) as first_i from r group by clip_id, shot_id having max(t) - min(t) >= 3.0),
b as (select r.*, h.first_i, least(greatest(2, round_even(3.0 / pace, 0)::int), h.len)::int as inner_w from r join g using (clip_id) join h on h.clip_id = r.clip_id and h.shot_id = r.shot_id),
c as (select *, sum(worth) over q as total, last_value(t) over q as end_t, count(*) over q as held from b window q as (partition by clip_id, shot_id order by i rows between current row and inner_w - 1 following)),
d as (select clip_id, shot_id, first_i, arg_max(t, (round(total, 6), -i)) as st, arg_max(end_t, (round(total, 6), -i)) as en, round(max(round(total, 6)) / any_value(inner_w) + 0.12, 6) as value from c where held = inner_w group by clip_id, shot_id, first_i),
e as (select clip_id, arg_max(st, (value, -first_i)) as s_start, arg_max(en, (value, -first_i)) as s_end from d group by clip_id),
j as (select g.*, s_start is not null as single, coalesce(s_start, w_start) as begin_t, case when s_start is not null then least(3.0, s_end - s_start) else greatest(1.0, least(3.0, w_end - w_start)) end as length from g left join best using (clip_id) left join e using (clip_id))
select clip_id, round(case when duration <= 3.0 or n < 4 then 0 when begin_t + length > duration then greatest(0, duration - length) else begin_t end, 6)::double as start,
  round(case when duration <= 3.0 then duration when n < 4 then least(3.0, duration) else length end, 6)::double as length, single as single_shot from j"""


def reel_steps(t):
    """Steps with the facts that a span is chosen by; who is seen, and how many, is read off the candidate."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("clip_id").orderBy("i")
    steps = sequences.shot_ids(t.v_steps, "low_corr")
    churn = F.coalesce((F.col("seen") & (F.col("candidate_track") != F.lag("candidate_track").over(order))).cast("double"), F.lit(0.0))
    return steps.select("clip_id", "i", "t", "speech", F.when(F.col("seen"), F.col("candidate_track")).otherwise(0).alias("faces"), (F.col("mouth") / 3000).alias("largest_share"), "shot_id", churn.alias("churn"), (F.max("t").over(Window.partitionBy("clip_id")) + 0.1).alias("duration"))


@query(_REEL)
def select_window(t):
    return framing.select_window(reel_steps(t), 3.0, 1.0).select("clip_id", _r6("start").alias("start"), _r6("length").alias("length"), "single_shot")


@query("""with c as (select clip_id, t from {v_steps} where low_corr),
f as (select s.clip_id, s.i, case when seen then candidate_track else 0 end as faces, mouth / 2000 as share, speech as conf, cx / 5 as sharp, cy / 3 as luma, coalesce(least(s.t - b.t, a.t - s.t), 10) as away
  from {v_steps} s asof left join c b on s.clip_id = b.clip_id and s.t >= b.t asof left join c a on s.clip_id = a.clip_id and s.t <= a.t),
p as (select *, max((faces > 0)::int) over (partition by clip_id) as any_face from f),
k as (select *, row_number() over (partition by clip_id order by i) - 1 as k, count(*) over (partition by clip_id) as n from p where any_face = 0 or faces > 0),
v as (select *, round(0.34 * greatest(0, least(1, sharp / 180)) + 0.34 * case when faces > 0 then greatest(0, least(1, share / 0.05)) * 0.7 + 0.3 * greatest(0, least(1, conf)) else 0 end
    + 0.17 * greatest(0, least(1, 1 - abs(luma - 128) / 110)) + 0.15 * greatest(0, least(1, away / 0.6)), 6)::double as score from k where k % greatest(1, n // 28) = 0 and k / greatest(1, n // 28) < 28)
select clip_id, arg_max(i, (score, -i)) as i, max(score) as score from v group by clip_id""")
def best_still(t):
    from gatelight.operators import asof

    cuts = t.v_steps.filter("low_corr").select("clip_id", "t")
    steps = asof.cut_distance(t.v_steps, cuts, "clip_id", "t")
    frames = steps.select("clip_id", "i", F.when(F.col("seen"), F.col("candidate_track")).otherwise(0).alias("faces"), (F.col("mouth") / 2000).alias("face_share"), F.col("speech").alias("face_conf"), (F.col("cx") / 5).alias("sharpness"), (F.col("cy") / 3).alias("luma"), "cut_distance")
    return framing.best_still(frames)


@query("""with s as (select clip_id, i, case when speech > 0.3 then candidate_track end as speaker, cx, avg(cx) over (partition by clip_id order by i rows between 3 preceding and current row) as px, seen from {v_steps}),
b as (select *, case when seen then greatest(least(cx + 40, px + 200) - greatest(cx - 40, px - 200), 0) / 80 end as inside,
    last_value(speaker ignore nulls) over (partition by clip_id order by i rows between unbounded preceding and 1 preceding) as prev, lag(px) over (partition by clip_id order by i) as px0 from s),
h as (select *, last_value(case when speaker is not null and speaker is distinct from prev then i end ignore nulls) over (partition by clip_id order by i) as at_i from b),
v as (select *, speaker is not null and inside is not null as speaks from h),
n as (select clip_id, count(*) filter (where speaks) as speech_steps, count(*) filter (where speaks and inside >= 0.9) as framed,
    count(*) filter (where speaks and inside < 0.9 and i - at_i <= 7 and abs(px - cx) < abs(px0 - cx) - 1.0) as in_transit from v group by clip_id)
select clip_id, case when speech_steps > 0 then round(framed / speech_steps, 6) end as strict, case when speech_steps > 0 then round((framed + in_transit) / speech_steps, 6) end as settled, speech_steps, framed, in_transit from n""")
def speaker_framing(t):
    from pyspark.sql.window import Window

    path = F.avg("cx").over(Window.partitionBy("clip_id").orderBy("i").rowsBetween(-3, 0))
    steps = t.v_steps.withColumn("crop_x", path)
    face, window = (boxes.from_center(F.col(x), F.lit(0.0), F.lit(w), F.lit(2.0)) for x, w in (("cx", 80.0), ("crop_x", 400.0)))
    steps = steps.select("clip_id", "i", F.when(F.col("speech") > 0.3, F.col("candidate_track")).alias("speaker"), F.when(F.col("seen"), boxes.contained(face, window)).alias("face_inside"), F.col("cx").alias("face_x"), "crop_x")
    return framing.framing_coverage(steps, 10.0).select("clip_id", _r6("strict").alias("strict"), _r6("settled").alias("settled"), "speech_steps", "framed", "in_transit")


@query("select clip_id, round(avg(sqrt(pow((cx - 640) / 1280, 2) + pow((cy - 360) / 720, 2))), 6) as offset from {v_steps} where seen group by clip_id".replace("as offset", 'as "offset"'))
def mean_subject_offset(t):
    return framing.centre_offset(t.v_steps.filter("seen"), "clip_id", F.col("cx"), F.col("cy"), CLIP_W, CLIP_H).select("clip_id", _r6("offset").alias("offset"))


@query("""with a as (select frame_id, (x2 - x1) * (y2 - y1) as g, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy from {v_faces})
select frame_id, round(sqrt(pow((sum(cx * g) / sum(g) - 540) / 1080, 2) + pow((sum(cy * g) / sum(g) - 960) / 1920, 2)), 6) as "offset" from a group by frame_id""")
def subject_offset(t):
    return framing.subject_offset(t.v_faces, "frame_id", FRAME_W, FRAME_H).select("frame_id", _r6("offset").alias("offset"))


@query("""select frame_id, face_no, round(greatest((x1 + x2) / 2 - (x2 - x1) * 1.5, 0), 6) as x1, round(greatest(y1 - (y2 - y1) * 0.35, 0), 6) as y1,
  round(least((x1 + x2) / 2 + (x2 - x1) * 1.5, 1080), 6) as x2, round(least(y2 + (y2 - y1) * 3.2, 1920), 6) as y2 from {v_faces}""")
def body_boxes(t):
    body = boxes.body(boxes.box("x1", "y1", "x2", "y2"), FRAME_W, FRAME_H)
    return t.v_faces.select("frame_id", "face_no", *[_r6(body[c]).alias(c) for c in ("x1", "y1", "x2", "y2")])


_TILES = """with d as (select *, unnest([2, 3, 4, 6, 8]) as n from (select media_id, width, height from {v_media})),
l as (select *, row_number() over (partition by media_id order by n desc) as back from d where greatest(width, height) / n >= 420),
k as (select *, greatest(1, width // n) as tw, greatest(1, height // n) as th from l where back <= 4),
xs as (select distinct media_id, n, width, height, tw, th, least(x, greatest(width - tw, 0)) as x from (select *, unnest(range(0, width, greatest(1, floor(tw * 0.75)::int))) as x from k) q),
ys as (select distinct media_id, n, least(y, greatest(height - th, 0)) as y from (select *, unnest(range(0, height, greatest(1, floor(th * 0.75)::int))) as y from k) q),
t as (select xs.*, y from xs join ys using (media_id, n)),
c as (select media_id, n, sum(count(*)) over (partition by media_id order by n) as used from t group by media_id, n)
select media_id, n::int as division, x::int as x, y::int as y, least(tw, width - x)::int as w, least(th, height - y)::int as h from t join c using (media_id, n) where used <= 80"""


@query(_TILES)
def detector_tiles(t):
    return crop.tiles(t.v_media.select("media_id", "width", "height"), "media_id")


@query(_TILES)
def lateral_tiles(t):
    """The same tiles by a table function, joined laterally in SQL."""
    tables.register(t._spark)
    return t._spark.sql("select media_id, t.* from {media} m, lateral frame_tiles(m.width, m.height) t", media=t.v_media)


def path_faces(t):
    """Faces of the three tracks where they are present; the one heard most in a step with speech is its speaker."""
    side, high = (F.col("cx").cast("int"), F.col("cy").cast("int"))
    x, y, size = (side * F.col("track")) % 1280, (high + 97 * F.col("track")) % 720, 40 + (side + 31 * F.col("track")) % 160
    placed = t.v_track_scores.filter("present").join(t.v_steps.filter("seen"), ["clip_id", "i"])
    boosted = F.when((F.col("track") == F.col("candidate_track")) & (F.col("speech") > 0.3), 2.2).otherwise(1 + 0.8 * F.col("score"))
    return placed.select("clip_id", "i", F.col("track").alias("face_no"), (x - size * 0.4).alias("x1"), (y - size * 0.5).alias("y1"), (x + size * 0.4).alias("x2"), (y + size * 0.5).alias("y2"), F.col("score").alias("conf"), boosted.alias("boost"))


@query()
def crop_path(t):
    """The vertical crop of each step of a landscape clip, anchored to the step before; no SQL: each step is a search from the last one's result."""
    profile = t.v_profiles.filter("profile_id = 'reel_vertical_9x16'").first()
    zones = t.v_reserved_zones.filter("profile_id = 'reel_vertical_9x16'").orderBy("zone").collect()
    rules = crop.Rules(action=tuple(profile[f"safe_{c}"] for c in ("x1", "y1", "x2", "y2")), reserved=tuple(tuple(z[f"z{c}"] for c in ("x1", "y1", "x2", "y2")) for z in zones), least_face=0.10)
    steps = sequences.shot_ids(t.v_steps, "low_corr").select("clip_id", "i", "shot_id")
    return crop.path(path_faces(t), steps, int(CLIP_W), int(CLIP_H), 9 / 16, rules=rules, boost=F.col("boost"))


def clip_detections(t):
    """Detections of clips with the mouth's aperture where it was seen: boxes as for ``crop_path``, in the step's shot."""
    shots = sequences.shot_ids(t.v_steps, "low_corr").select("clip_id", "i", "t", "shot_id", "mouth", "speech")
    aperture = F.when((F.col("i") + F.col("face_no")) % 5 > 0, (F.col("mouth") * F.col("face_no") % 17) / 17)
    return path_faces(t).join(shots, ["clip_id", "i"]).select("clip_id", F.col("i").alias("frame_i"), "t", "face_no", "x1", "y1", "x2", "y2", "shot_id", aperture.alias("aperture"))


def tracked_series(t):
    """Every detection with its track."""
    kept = ("t", "x1", "y1", "x2", "y2", "shot_id", "aperture")
    return tracking.track_faces(clip_detections(t), "clip_id", (CLIP_W**2 + CLIP_H**2) ** 0.5, kept)


def clip_audio(t):
    """The sound of clips, sampled beside their steps."""
    return t.v_steps.select("clip_id", (F.col("t") + 0.03).alias("t"), F.col("speech").alias("energy"), F.greatest(F.lit(0.0), 1 - F.col("speech") / 2).alias("speech"))


@query()
def ncc_speaker(t):
    """How well each track's mouth follows the sound of its clip, at every step the track is present."""
    scored = speakers.track_scores(tracked_series(t), t.v_steps, clip_audio(t), 10.0)
    return scored.select("clip_id", F.col("i").cast("int").alias("i"), "track_id", _r6("score").alias("score"))


@query()
def speaker_timeline(t):
    """From detections to the speaker of each step: tracks, mouths against the clip's sound, shares of those present, hysteresis; no SQL, as tracks come of an assignment."""
    return speakers.timeline(tracked_series(t), sequences.shot_ids(t.v_steps, "low_corr"), clip_audio(t), 10.0).withColumn("score", _r6("score"))


@query()
def clip_tracks(t):
    """Tracks of clips as their detections are taken up, live ones and retired ones of two hits or more; the live ones were seen in the last steps of their clip."""
    kept = tracked_series(t)
    ends = kept.groupBy("clip_id").agg(F.max("frame_i").alias("end"), F.max("shot_id").alias("last_shot"))
    all_ = tracking.finished(kept, "clip_id", 1).join(kept.groupBy("clip_id", "track_id").agg(F.max("shot_id").alias("shot")), ["clip_id", "track_id"]).join(ends, "clip_id")
    live = (F.col("end") - F.col("last_frame") <= tracking.MAX_MISSES) & (F.col("shot") == F.col("last_shot"))
    return tracking.all_tracks(all_.filter(live), tracking.finished(kept, "clip_id"), "clip_id")


@query("""with c as (select clip_id, i, least(cx, 875) as x, candidate_track as intact, low_corr::int as clipped, (not seen)::int as dropped from {v_steps}),
d as (select *, abs(x + 202.5 - 640) / 1280 as dx from c)
select clip_id, i, case when dx > 0.02 then 'crop centre is off the frame centre by ' || printf('%.1f%%', round(dx * 100, 1)) || ' across and 0.0% down, to hold the subject' else 'the subject is centred, and so is the crop' end
  || '; ' || intact || ' face(s) whole in the frame' || case when dropped > 0 then '; 1 face(s) left out for the primary subject' else '' end || case when clipped > 0 then '; WARNING: 1 face(s) cut' else '' end as rationale from d""")
def crop_rationale(t):
    """Why each step's window lies where it does, as the lines of a report."""
    crops = t.v_steps.select("clip_id", "i", F.least("cx", F.lit(875.0)).alias("x"), F.lit(0.0).alias("y"), F.lit(405).alias("w"), F.lit(720).alias("h"), F.col("candidate_track").alias("intact"), F.col("low_corr").cast("int").alias("clipped"), (~F.col("seen")).cast("int").alias("dropped"))
    return framing.rationale(crops, CLIP_W, CLIP_H).select("clip_id", "i", F.array_join("rationale", "; ").alias("rationale"))
