"""Registered queries of the engine, each with the SQL it is held against."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatelight.functions import boxes, network
from gatelight.operators import asof, crop, folds, maps, sequences, store, tracking
from gatelight.streaming import audit

from . import clips, gate, service  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES, query

NOW = dt.datetime(2024, 1, 20)
FRAME_W, FRAME_H = 1080.0, 1920.0
CLIP_W, CLIP_H = 1280.0, 720.0


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- metadata store -------------------------------------------------------------------------------------------------------

@query("select * from {v_variants} where status = 'published'")
def library(t):
    return store.library(t.v_variants)


@query("select * from {v_variants} where asset_id = 17")
def variants_of_asset(t):
    return store.variants_of_asset(t.v_variants, 17)


@query("select * from {v_variants} where asset_id = 17 and profile_id = 'reel_vertical_9x16' order by created_at, variant_id limit 1")
def variant_lookup(t):
    return store.variant_lookup(t.v_variants, 17, "reel_vertical_9x16")


@query("""select a.asset_id, a.title, a.kind, count(v.variant_id) as variants, count(v.variant_id) filter (where v.status = 'published') as published,
  count(v.variant_id) filter (where v.status <> 'published') as not_published from {v_assets} a left join {v_variants} v on a.asset_id = v.asset_id group by all""")
def asset_rollup(t):
    return store.asset_rollup(t.v_assets, t.v_variants)


@query("select kind, sum(n)::bigint as variants, sum(p)::bigint as published from (select a.kind, count(*) as n, count(*) filter (where v.status = 'published') as p from {v_assets} a join {v_variants} v on a.asset_id = v.asset_id group by a.asset_id, a.kind) group by rollup (kind)")
def library_totals(t):
    per_asset = store.asset_rollup(t.v_assets, t.v_variants).filter("variants > 0")
    return per_asset.rollup("kind").agg(F.sum("variants").alias("variants"), F.sum("published").alias("published"))


@query("select asset_id, count(*) as variants, count(*) filter (where status = 'published') as published, count(*) filter (where status <> 'published') as quarantined from {v_variants} group by asset_id")
def job_counts(t):
    return store.job_counts(t.v_variants)


_AUDIT = "id, at, action, outcome, asset_id"


@query(f"select {_AUDIT} from {{v_audit}} order by at desc, id desc limit 200 offset 50")
def audit_page(t):
    return store.page(t.v_audit, "at", "id", 200, 50).select(*_AUDIT.split(", "))


@query("select asset_id, title, kind, created_at from {v_assets} order by created_at desc nulls last, asset_id desc limit 100")
def assets_page(t):
    """The newest assets; those without a time come last."""
    return store.page(t.v_assets, "created_at", "asset_id", 100).select("asset_id", "title", "kind", "created_at")


@query(f"select {_AUDIT} from {{v_audit}} where asset_id = 7 and action = 'variant.published'")
def audit_filtered(t):
    return store.audit_filter(t.v_audit, 7, "variant.published").select(*_AUDIT.split(", "))


@query(f"select {_AUDIT} from {{v_audit}} where at >= timestamp '2024-01-20' - interval 10 day")
def retention_purge(t):
    return store.retention(t.v_audit, NOW, 10)[0].select(*_AUDIT.split(", "))


@query("select count(*) filter (where at < timestamp '2024-01-20' - interval 10 day) as purged from {v_audit}")
def retention_count(t):
    return store.retention(t.v_audit, NOW, 10)[1]


@query("select v.* from {v_variants} v where v.asset_id not in (select asset_id from {v_assets} where kind = 'video')")
def cascade_delete(t):
    return store.cascade_delete(t.v_assets, t.v_variants, t.v_assets.filter("kind = 'video'").select("asset_id"))[1].select(*t.v_variants.columns)


@query("""select asset_id, profile_id, variant_id, status, created_at from (select *, row_number() over (partition by asset_id, profile_id order by created_at desc, variant_id desc) as k from {v_variants}) where k = 1""")
def upsert_latest(t):
    return store.upsert_latest(t.v_variants, ["asset_id", "profile_id"], "created_at", "variant_id").select("asset_id", "profile_id", "variant_id", "status", "created_at")


@query("""select asset_id, id, at, action from (select *, row_number() over (partition by asset_id order by at desc, id desc) as k from {v_audit} where action in ('asset.uploaded', 'job.submitted')) where k = 1""")
def latest_active_job(t):
    return store.latest_active_job(t.v_audit, ["asset.uploaded", "job.submitted"]).select("asset_id", "id", "at", "action")


@query("""select a.asset_id, p.profile_id from {v_assets} a join {v_profiles} p on a.kind = p.kind
where not exists (select 1 from {v_variants} v where v.asset_id = a.asset_id and v.profile_id = p.profile_id)""")
def unrendered_profiles(t):
    return store.unrendered_profiles(t.v_assets, t.v_variants, t.v_profiles)


@query("""select asset_id, min(at) filter (where action = 'job.submitted') as started_at, max(at) filter (where action in ('job.succeeded', 'variant.quarantined')) as finished_at from {v_audit} group by asset_id""")
def job_times(t):
    return store.first_last_times(t.v_audit)


@query("select asset_id, profile_id, count(*) as n from {v_variants} group by all having count(*) > 1")
def duplicate_variants(t):
    return store.duplicates(t.v_variants, ["asset_id", "profile_id"])


@query("select v.asset_id, v.variant_id, p.kind as profile_kind, p.ratio from {v_variants} v left join {v_profiles} p using (profile_id) where v.status = 'published'")
def variant_labels(t):
    sheet = F.broadcast(t.v_profiles.select("profile_id", F.col("kind").alias("profile_kind"), "ratio"))
    return store.library(t.v_variants).join(sheet, "profile_id", "left").select("asset_id", "variant_id", "profile_kind", "ratio")


# --- requests -------------------------------------------------------------------------------------------------------------

#: Hops as they come in, with the text each stands for or null where it is no address.
_SPELLINGS = """(values (' 198.51.100.7 ', '198.51.100.7'), ('198.51.100.7:51234', '198.51.100.7'), ('[2001:db8::1]:443', '2001:db8::1'), ('2001:DB8:0:0:0:0:0:1', '2001:db8::1'), ('1:2:3', null),
  ('12:30:45', null), ('::ffff:300.1.1.1', null), ('::ffff:1.2.3.4', '::ffff:1.2.3.4'), ('1:0:0:2:0:0:0:3', '1:0:0:2::3'), ('0:0:1::', '0:0:1::'), ('1:2:3:4:5:6:7::', '1:2:3:4:5:6:7:0'),
  ('::', '::'), ('1::2::3', null), (':::1', null), ('1.2.3.04', null), ('256.1.1.1', null), ('::1.2.3.4', '::102:304'), ('fe80::1%eth0', 'fe80::1%eth0'), ('not-an-ip', null), ('', null),
  ('1:2:3:4:5:6:7:8:9', null), ('12345::', null), ('g::1', null), ('1:0:2:0:3:0:4:0', '1:0:2:0:3:0:4:0'), ('70.132.0.9', '70.132.0.9')) s(raw, ip)"""
_HOPS = f"""with spelled as (select raw, ip, (row_number() over () - 1)::int as k from {_SPELLINGS}),
chain as (select a.id, list(s.ip order by j) filter (where s.ip is not null) as c
  from {{v_audit}} a cross join (select unnest([0, 1, 2]) as j) cross join spelled s where s.k = (a.id * (j + 2) + j) % 25 and a.id % 7 <> 0 and j <= a.id % 4 group by a.id),
n as (select unnest([0, 1, 2, 3]) as hops)
select a.id, n.hops, case when hops = 0 or c is null then a.peer else c[greatest(len(c) - hops + 1, 1)] end as ip, hops > 0 and c is not null as forwarded
from {{v_audit}} a cross join n left join chain on a.id = chain.id"""


@query(_HOPS)
def client_ip(t):
    raw = F.array(*[F.lit(x) for x in re.findall(r"\('([^']*)', ", _SPELLINGS)])
    parts = F.transform(F.sequence(F.lit(0), F.least(F.col("id") % 4, F.lit(2))), lambda j: raw[((F.col("id") * (j + 2) + j) % 25).cast("int")])
    header = t.v_audit.select("id", "peer", F.when(F.col("id") % 7 != 0, F.array_join(parts, ",")).alias("forwarded"))
    chained = header.withColumn("chain", network.hops(F.col("forwarded")))
    picks = F.array(*[F.struct(F.lit(n).alias("hops"), network.client_ip(F.col("peer"), F.col("chain"), n).alias("c")) for n in range(4)])
    return chained.select("id", F.explode(picks).alias("p")).select("id", "p.hops", "p.c.ip", "p.c.forwarded")


@query("""with x as (select event_id as id, case event_id % 4 when 0 then '["a", "b"]' when 1 then ' a, b ,,c' when 2 then '{"k": 1}' else '' end as s from {events})
select id, case when s like '[%' then ['a', 'b'] when s like '{%' or s = '' then null else ['a', 'b', 'c'] end as ids from x""")
def profile_ids(t):
    case = F.expr("""case event_id % 4 when 0 then '["a", "b"]' when 1 then ' a, b ,,c' when 2 then '{"k": 1}' else '' end""")
    return t.events.select(F.col("event_id").alias("id"), network.profile_ids(case).alias("ids"))


# --- boxes and subject rules ----------------------------------------------------------------------------------------------

def _box(prefix: str = ""):
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


_FACES = """f as (select *, 0.15 * (x2 - x1) as sx, 0.15 * (y2 - y1) as sy, x2 - x1 as fw, y2 - y1 as fh from {v_faces}),
c as (select *, x1 + sx as c1, y1 + sy as c2, x2 - sx as c3, y2 - sy as c4, (fh >= 0.45 * max(fh) over (partition by frame_id) or fh >= 0.055 * 1920) as subject from f)"""


@query("""select a.frame_id, a.face_no as a, b.face_no as b, round(i / (a.size_px * a.size_px * 0.8 + b.size_px * b.size_px * 0.8 - i), 6) as iou
from (select a.frame_id, a.face_no, a.size_px, b.face_no as bn, b.size_px as bs,
    greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as i
  from {v_faces} a join {v_faces} b on a.frame_id = b.frame_id and a.face_no < b.face_no) a, lateral (select a.bn as face_no, a.bs as size_px) b where i > 0""")
def iou_pairs(t):
    a, b = (t.v_faces.select("frame_id", F.col("face_no").alias(n), _box().alias(f"box_{n}")) for n in "ab")
    pairs = a.join(b, "frame_id").filter("a < b")
    return pairs.withColumn("iou", r6(boxes.iou(F.col("box_a"), F.col("box_b")))).filter(boxes.area(boxes.intersect(F.col("box_a"), F.col("box_b"))) > 0).select("frame_id", "a", "b", "iou")


@query("""select frame_id, face_no, round(greatest(least(x2, 1080) - greatest(x1, 0), 0) * greatest(least(y2, 1920) - greatest(y1, 0), 0) / ((x2 - x1) * (y2 - y1)), 6) as inside from {v_faces}""")
def containment(t):
    frame = boxes.box(0.0, 0.0, FRAME_W, FRAME_H)
    return t.v_faces.select("frame_id", "face_no", r6(boxes.contained(_box(), frame)).alias("inside"))


@query("""select frame_id, face_no, cast(round_even(x1, 0) as int) as x, cast(round_even(y1, 0) as int) as y, cast(round_even(x2 - x1, 0) as int) as w, cast(round_even(y2 - y1, 0) as int) as h,
  greatest(x1, 0) / 1080 as nx1, least(y2, 1920) / 1920 as ny2 from {v_faces}""")
def box_forms(t):
    px, clamped = boxes.to_int_xywh(_box()), boxes.normalized(boxes.clamp(_box(), FRAME_W, FRAME_H), FRAME_W, FRAME_H)
    return t.v_faces.select("frame_id", "face_no", px["x"].alias("x"), px["y"].alias("y"), px["w"].alias("w"), px["h"].alias("h"), clamped["x1"].alias("nx1"), clamped["y2"].alias("ny2"))


@query("""with n as (select n, k, r from (select unnest(['16:9', '9:16', '1:1', '4:5']) as n, unnest([16/9::double, 9/16::double, 1.0, 0.8]) as r, unnest([1, 2, 3, 4]) as k) x),
m as (select media_id, round(cast(split_part(p.ratio, ':', 1) as double) / cast(split_part(p.ratio, ':', 2) as double), 6) as wanted, m.width / m.height::double as value from {v_media} m join {v_profiles} p using (profile_id))
select media_id, wanted, coalesce(arg_min(n, k), printf('%.4f', any_value(value))) as label from m left join n on abs(value - r) <= 0.02 * r group by media_id, wanted""")
def aspect_parse_label(t):
    """Per medium the ratio its profile writes, as a number, and the name of the ratio it has."""
    media = t.v_media.join(F.broadcast(t.v_profiles.select("profile_id", "ratio")), "profile_id")
    return media.select("media_id", r6(boxes.parse_aspect(F.col("ratio"))).alias("wanted"), boxes.aspect_label(F.col("width") / F.col("height")).alias("label"))


@query("""select m.media_id, greatest(floor(case when w > r * h then h * r else w end), 1)::int as w, greatest(floor(case when w > r * h then h else w / r end), 1)::int as h
from (select m.media_id, m.width::double as w, m.height::double as h, cast(split_part(p.ratio, ':', 1) as double) / cast(split_part(p.ratio, ':', 2) as double) as r
  from {v_media} m join {v_profiles} p on p.profile_id = 'feed_portrait_4x5') m""")
def fit_box(t):
    fit = boxes.fit_to_aspect(F.col("width").cast("double"), F.col("height").cast("double"), F.lit(4 / 5))
    return t.v_media.select("media_id", fit["w"].alias("w"), fit["h"].alias("h"))


_INTEGRITY = f"""with {_FACES},
g as (select *, greatest(least(c3, 1080) - greatest(c1, 0), 0) * greatest(least(c4, 1920) - greatest(c2, 0), 0) / ((c3 - c1) * (c4 - c2)) as inside,
  greatest(least(x2 + 0.18 * fw, 1080) - greatest(x1 - 0.18 * fw, 0), 0) * greatest(least(y2 + 0.20 * fh, 1920) - greatest(y1 - 0.38 * fh, 0), 0) / (1.36 * fw * 1.58 * fh) as head from c)"""


@query(_INTEGRITY + """select frame_id, count(*) as faces, count(*) filter (where inside < 0.995 and inside > 0.02 and subject) as clipped, count(*) filter (where inside < 0.995 and inside > 0.02 and not subject) as extras,
  count(*) filter (where inside >= 0.995 and subject and head < 0.90) as tight,
  case when count(*) filter (where inside < 0.995 and inside > 0.02 and subject) > 0 then 'fail' when count(*) filter (where inside < 0.995 and inside > 0.02 and not subject) > 0 then 'warn'
    when count(*) filter (where inside >= 0.995 and subject and head < 0.90) > 0 then 'warn' else 'pass' end as outcome from g group by frame_id""")
def face_integrity(t):
    frame = boxes.box(0.0, 0.0, FRAME_W, FRAME_H)
    faces = sequences.significant(t.v_faces.withColumn("b", _box()), boxes.height(F.col("b")), FRAME_H)
    inside, head = boxes.contained(boxes.core(F.col("b")), frame), boxes.contained(boxes.head(F.col("b")), frame)
    faces = faces.select("frame_id", "subject", inside.alias("inside"), head.alias("head"))
    cut = (F.col("inside") < 0.995) & (F.col("inside") > 0.02)
    out = faces.groupBy("frame_id").agg(F.count("*").alias("faces"), F.count_if(cut & F.col("subject")).alias("clipped"), F.count_if(cut & ~F.col("subject")).alias("extras"), F.count_if((F.col("inside") >= 0.995) & F.col("subject") & (F.col("head") < 0.90)).alias("tight"))
    return out.withColumn("outcome", F.when(F.col("clipped") > 0, "fail").when((F.col("extras") > 0) | (F.col("tight") > 0), "warn").otherwise("pass"))


def _band(bad, n):
    return F.when(n == 0, "skip").when(bad / F.greatest(n, F.lit(1)) <= 0.05, "pass").when(bad / F.greatest(n, F.lit(1)) <= 0.20, "warn").otherwise("fail")


@query(f"""with {_FACES}, z as (select * from {{v_profiles}} where profile_id = 'reel_vertical_9x16'),
g as (select frame_id, greatest(least(c3, safe_x2 * 1080) - greatest(c1, safe_x1 * 1080), 0) * greatest(least(c4, safe_y2 * 1920) - greatest(c2, safe_y1 * 1920), 0) / ((c3 - c1) * (c4 - c2)) as inside from c, z where subject)
select frame_id, count(*) as checked, count(*) filter (where inside < 0.97) as violations, case when count(*) filter (where inside < 0.97) / count(*) <= 0.05 then 'pass' when count(*) filter (where inside < 0.97) / count(*) <= 0.20 then 'warn' else 'fail' end as outcome from g group by frame_id""")
def safe_zone(t):
    zone = F.broadcast(t.v_profiles.filter("profile_id = 'reel_vertical_9x16'").select(boxes.to_pixels(boxes.box("safe_x1", "safe_y1", "safe_x2", "safe_y2"), FRAME_W, FRAME_H).alias("zone")))
    faces = sequences.significant(t.v_faces.withColumn("b", _box()), boxes.height(F.col("b")), FRAME_H).filter("subject").join(zone)
    bad = boxes.contained(boxes.core(F.col("b")), F.col("zone")) < 0.97
    out = faces.groupBy("frame_id").agg(F.count("*").alias("checked"), F.count_if(bad).alias("violations"))
    return out.withColumn("outcome", _band(F.col("violations"), F.col("checked")))


@query(f"""with {_FACES}, z as (select zone, zx1 * 1080 as z1, zy1 * 1920 as z2, zx2 * 1080 as z3, zy2 * 1920 as z4 from {{v_reserved_zones}} where profile_id = 'reel_vertical_9x16'),
g as (select frame_id, zone, greatest(least(c3, z3) - greatest(c1, z1), 0) * greatest(least(c4, z4) - greatest(c2, z2), 0) / ((c3 - c1) * (c4 - c2)) as overlap from c, z where subject)
select frame_id, zone, count(*) as faces, round(max(overlap), 6) as worst from g where overlap > 0.12 group by all""")
def reserved_zone(t):
    zones = t.v_reserved_zones.filter("profile_id = 'reel_vertical_9x16'").select("zone", boxes.to_pixels(boxes.box("zx1", "zy1", "zx2", "zy2"), FRAME_W, FRAME_H).alias("z"))
    faces = sequences.significant(t.v_faces.withColumn("b", _box()), boxes.height(F.col("b")), FRAME_H).filter("subject").select("frame_id", boxes.core(F.col("b")).alias("core"))
    hits = faces.join(F.broadcast(zones)).withColumn("overlap", boxes.contained(F.col("core"), F.col("z"))).filter("overlap > 0.12")  # three zones, fixed by the sheet
    return hits.groupBy("frame_id", "zone").agg(F.count("*").alias("faces"), r6(F.max("overlap")).alias("worst"))


_GAP = "with s as (select *, last_value(case when seen then t end ignore nulls) over (partition by clip_id order by i) as last_seen from {v_steps}), g as (select clip_id, count(*) as samples, avg(seen::int) as coverage, coalesce(max(case when not seen then t - last_seen end), 0) as gap from s group by clip_id)"


@query(_GAP + " select clip_id, samples, round(coverage, 6) as coverage, round(gap, 6) as longest_gap_s, case when round(gap, 6) > 1.5 or coverage < 0.70 then 'fail' else 'pass' end as outcome from g")
def presence_gap(t):
    gaps = sequences.presence_gap(t.v_steps, "seen").withColumn("longest_gap_s", r6("longest_gap_s"))
    lost = (F.col("longest_gap_s") > 1.5) | (F.col("coverage") < 0.70)
    return gaps.select("clip_id", "samples", r6("coverage").alias("coverage"), "longest_gap_s", F.when(lost, "fail").otherwise("pass").alias("outcome"))


@query("select frame_id, arg_max(face_no, (round((x2 - x1) * (y2 - y1) * (0.5 + conf) * (1 + 2 * (face_no % 3) / 4.0::double), 6), -face_no)) as face_no from {v_faces} group by frame_id")
def primary_face(t):
    """The largest face of a frame, by confidence and by how much it speaks."""
    speaking = F.col("face_no") % 3 / 4
    rank = F.struct(F.round(boxes.area(_box()) * (0.5 + F.col("conf")) * (1 + 2 * speaking), 6).alias("r"), (-F.col("face_no")).alias("n"))
    return t.v_faces.groupBy("frame_id").agg(F.max_by("face_no", rank).alias("face_no"))


# --- windows --------------------------------------------------------------------------------------------------------------

@query("select clip_id, i, sum(low_corr::int) over (partition by clip_id order by i)::int as shot_id from {v_steps}")
def shot_ids(t):
    return sequences.shot_ids(t.v_steps, "low_corr").select("clip_id", "i", "shot_id")


@query("""select clip_id, i, round(case when n < 8 then 0.70 else least(0.92, m - 0.10) end, 6) as threshold from (
  select clip_id, i, count(speech) over w as n, quantile_cont(speech, 0.5) over w as m from {v_steps} window w as (partition by clip_id order by i rows between 60 preceding and 1 preceding))""")
def running_median_cut(t):
    return sequences.running_median_cut(t.v_steps, "speech").select("clip_id", "i", r6("threshold").alias("threshold"))


@query("""with d as (select clip_id, sqrt(pow((cx - lag(cx) over w) / 1280, 2) + pow((cy - lag(cy) over w) / 720, 2)) as d from {v_steps} window w as (partition by clip_id order by i))
select clip_id, round(coalesce(avg(d), 0), 6) as mean_step, round(coalesce(max(d), 0), 6) as max_step, round(coalesce(sum(d), 0), 6) as total, round(coalesce(avg(case when d is not null then (d > 5e-4)::int end), 0), 6) as moving_share from d group by clip_id""")
def path_motion(t):
    out = sequences.path_motion(t.v_steps, CLIP_W, CLIP_H)
    return out.select("clip_id", *[r6(c).alias(c) for c in ("mean_step", "max_step", "total", "moving_share")])


@query("select clip_id, round(case when count(*) < 3 then 0 else sqrt(pow((max(cx) - min(cx)) / 1280, 2) + pow((max(cy) - min(cy)) / 720, 2)) end, 6) as motion from {v_steps} group by clip_id")
def subject_motion(t):
    return sequences.subject_motion(t.v_steps, CLIP_W, CLIP_H).select("clip_id", r6("motion").alias("motion"))


@query("""with s as (select clip_id, candidate_track as c, lag(candidate_track) over (partition by clip_id order by i) as p from {v_steps} where seen)
select clip_id, count(*) filter (where c <> p) as switches, count(distinct c) as speakers from s group by clip_id""")
def speaker_switches(t):
    return sequences.switches(t.v_steps.withColumn("active", F.when(F.col("seen"), F.col("candidate_track"))), "active")


_SCORE = "speech * 1.0 + seen::int * 0.45 - low_corr::int * 0.60"


def _score():
    return F.col("speech") * 1.0 + F.col("seen").cast("int") * 0.45 - F.col("low_corr").cast("int") * 0.60


@query(f"""with s as (select clip_id, i, round(sum({_SCORE}) over w, 6) as s, count(*) over w as n from {{v_steps}} window w as (partition by clip_id order by i rows between current row and 9 following))
select clip_id, arg_max(i, (s, -i)) as start_i, max(s) as total from s where n = 10 group by clip_id""")
def best_window(t):
    return sequences.best_window(t.v_steps, _score(), 10, ["clip_id"])


@query(f"""with h as (select *, sum(low_corr::int) over (partition by clip_id order by i)::int as shot_id from {{v_steps}}),
s as (select clip_id, shot_id, i, round(sum({_SCORE}) over w, 6) as s, count(*) over w as n from h window w as (partition by clip_id, shot_id order by i rows between current row and 4 following))
select clip_id, arg_max(shot_id, (s, -i)) as shot_id, arg_max(i, (s, -i)) as start_i, max(s) as total from s where n = 5 group by clip_id""")
def best_single_shot(t):
    per_shot = sequences.best_window(sequences.shot_ids(t.v_steps, "low_corr"), _score(), 5, ["clip_id", "shot_id"])
    best = per_shot.groupBy("clip_id").agg(F.max_by(F.struct("shot_id", "start_i", "total"), F.struct("total", -F.col("start_i"))).alias("b"))
    return best.select("clip_id", "b.shot_id", "b.start_i", "b.total")


@query("""with m as (select clip_id, i, coalesce((candidate_track <> lag(candidate_track) over (partition by clip_id order by i))::int, 0) as mark from {v_steps})
select clip_id, i, round(sum(mark) over (partition by clip_id order by i rows between 5 preceding and 4 following) / 10.0, 6)::double as churn from m""")
def churn(t):
    return sequences.churn(t.v_steps, "candidate_track", 10).select("clip_id", "i", r6("churn").alias("churn"))


@query("""with m as (select clip_id, i, candidate_track, case when candidate_track is distinct from lag(candidate_track) over (partition by clip_id order by i) then 1 else 0 end as new from {v_steps}),
r as (select *, sum(new) over (partition by clip_id order by i) as run from m)
select clip_id, run::bigint as run, min(candidate_track) as candidate_track, min(i) as first_i, max(i) as last_i, count(*) as n from r group by clip_id, run""")
def runs(t):
    return sequences.runs(t.v_steps, "candidate_track")


@query("""with m as (select frame_id, face_no, conf, max(conf) over (partition by frame_id) as top from {v_faces}), e as (select *, exp((conf - top) / 0.18) as w from m)
select frame_id, face_no, round(w / sum(w) over (partition by frame_id), 6) as p from e""")
def softmax_step(t):
    return sequences.softmax(t.v_faces, "conf", ["frame_id"]).select("frame_id", "face_no", r6("p").alias("p"))


@query("""select clip_id, i, round(abs(case when b is null and a is null then 0 when b is null then a - mouth when a is null then mouth - b else (a - b) / 2 end), 6) as gradient
from (select *, lag(mouth) over w as b, lead(mouth) over w as a from {v_steps} window w as (partition by clip_id order by i))""")
def mouth_gradient(t):
    return sequences.gradient(t.v_steps, "mouth").select("clip_id", "i", r6("gradient").alias("gradient"))


@query("select clip_id, round(avg((speech > 0.5)::int), 6) as speech_ratio from {v_steps} group by clip_id")
def speech_ratio(t):
    return sequences.speech_ratio(t.v_steps).select("clip_id", r6("speech_ratio").alias("speech_ratio"))


@query("""with d as (select *, t - lag(t) over (partition by clip_id order by i) as dt from {v_steps})
select clip_id, round(quantile_cont(speech, 0.25), 6) as p25, round(quantile_cont(speech, 0.95), 6) as p95, round(quantile_cont(dt, 0.5), 6) as median_dt,
  round(case when count(speech) > 2 then quantile_cont(speech, 0.5) else max(speech) end, 6) as typical from d group by clip_id""")
def step_percentiles(t):
    out = sequences.percentiles(t.v_steps, "speech")
    return out.select("clip_id", *[r6(c).alias(c) for c in ("p25", "p95", "median_dt", "typical")])


# --- as-of ----------------------------------------------------------------------------------------------------------------

_PROBES = "p as (select clip_id, i, t + 0.03 as t from {v_steps}), s as (select clip_id, t, speech, cx, low_corr, sum(low_corr::int) over (partition by clip_id order by i)::int as shot_id from {v_steps} where seen)"
_SIDES = _PROBES + """, n as (select p.clip_id, p.i, p.t, b.t as bt, b.speech as bs, b.cx as bx, b.shot_id as bshot, a.t as at_, a.speech as as_, a.cx as ax, a.shot_id as ashot
  from p asof left join s b on p.clip_id = b.clip_id and p.t >= b.t asof left join s a on p.clip_id = a.clip_id and p.t <= a.t)"""


def _sides(t):
    # every step, shifted, against the steps on which the subject was seen
    probes = t.v_steps.select("clip_id", "i", (F.col("t") + 0.03).alias("t"))
    seen = sequences.shot_ids(t.v_steps.filter("seen"), "low_corr").select("clip_id", "t", "speech", "cx", "shot_id")
    return probes, seen


@query(f"with {_SIDES} select clip_id, i, case when bt is null or (at_ is not null and round(at_ - t, 6) < round(t - bt, 6)) then as_ else bs end as nearest from n")
def nearest_step(t):
    return asof.nearest(*_sides(t), "clip_id", "t", "speech").select("clip_id", "i", "nearest")


@query(f"with {_SIDES} select clip_id, i, case when bt is null then as_ when at_ is null or at_ <= bt then bs else bs + (as_ - bs) * (t - bt) / (at_ - bt) end as speech from n")
def interp_series(t):
    return asof.interpolate(*_sides(t), "clip_id", "t", "speech").select("clip_id", "i", "speech")


@query(f"with {_SIDES} select clip_id, i, round(case when bshot <> ashot then ax when bt is null then ax when at_ is null or at_ <= bt then bx else bx + (ax - bx) * (t - bt) / (at_ - bt) end, 6) as cx from n")
def path_interp(t):
    return asof.path_lookup(*_sides(t), "clip_id", "t", ["cx"], "shot_id").select("clip_id", "i", r6("cx").alias("cx"))


@query("""with c as (select clip_id, t from {v_steps} where low_corr)
select s.clip_id, s.i, round(coalesce(least(s.t - b.t, a.t - s.t), 10), 6) as cut_distance from {v_steps} s asof left join c b on s.clip_id = b.clip_id and s.t >= b.t asof left join c a on s.clip_id = a.clip_id and s.t <= a.t""")
def cut_distance(t):
    cuts = t.v_steps.filter("low_corr").select("clip_id", "t")
    return asof.cut_distance(t.v_steps.select("clip_id", "i", "t"), cuts, "clip_id", "t").select("clip_id", "i", r6("cut_distance").alias("cut_distance"))


@query("select clip_id, i, t from {v_steps} where t between 0.5 - 1e-6 and 1.5 + 1e-6")
def time_slice(t):
    return asof.time_slice(t.v_steps, "t", 0.5, 1.5).select("clip_id", "i", "t")


# --- folds, search and trackers -------------------------------------------------------------------------------------------

_FOLD = """with recursive s as materialized (select clip_id, i, candidate_track as c, speech as q, sum(low_corr::int) over (partition by clip_id order by i)::int as shot from {v_steps}),
f as (select s.clip_id, s.i, s.shot, case when q < 0.25 or q < 0.30 then -1 else c end as active, case when q < 0.30 then 1 else 0 end as dwell from s where i = 0
  union all
  select n.clip_id, n.i, n.shot,
    case when not (n.q < 0.30) and (a = -1 or (n.c <> a and n.q >= 0.22 and d >= 12)) then n.c else a end,
    case when not (n.q < 0.30) and (a = -1 or (n.c <> a and n.q >= 0.22 and d >= 12)) then 0 else d + 1 end
  from (select s.*, case when s.shot <> f.shot then -1 else f.active end as a, case when s.shot <> f.shot then 0 else f.dwell end as d from f join s on s.clip_id = f.clip_id and s.i = f.i + 1) n)
select clip_id, i, active::int as active, dwell::int as dwell from f"""


@query(_FOLD)
def hysteresis(t):
    steps = sequences.shot_ids(t.v_steps, "low_corr").withColumn("q", F.col("speech"))
    return folds.hysteresis(steps, "clip_id", "candidate_track", "q", "speech", "shot_id")


def _clip_faces(t):
    # seven detections of a frame are spread over steps of a clip: frame number is the order's low digits
    return t.v_faces.select((F.col("frame_id") % 997).alias("clip_id"), (F.col("frame_id") / 997).cast("int").alias("frame_i"), "face_no", "x1", "y1", "x2", "y2", F.lit(0).alias("shot_id"))


@query()
def track_faces(t):
    return tracking.track_faces(_clip_faces(t), "clip_id", (FRAME_W**2 + FRAME_H**2) ** 0.5)


@query()
def finished_tracks(t):
    return tracking.finished(tracking.track_faces(_clip_faces(t), "clip_id", (FRAME_W**2 + FRAME_H**2) ** 0.5), "clip_id")


_MATCH_COST = """with p as (select a.frame_id, a.face_no as a, b.face_no as b, a.x2 - a.x1 as wa, b.x2 - b.x1 as wb, (a.x2 - a.x1) * (a.y2 - a.y1) as aa, (b.x2 - b.x1) * (b.y2 - b.y1) as ab,
  greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as common,
  sqrt(pow((a.x1 + a.x2 - b.x1 - b.x2) / 2, 2) + pow((a.y1 + a.y2 - b.y1 - b.y2) / 2, 2)) / sqrt(1080 * 1080 + 1920 * 1920) as away from {v_faces} a join {v_faces} b on a.frame_id = b.frame_id and b.face_no > a.face_no),
q as (select *, common / (aa + ab - common) as iou, greatest(wa, wb) / least(wa, wb) as scale from p)
select frame_id, a, b, round(case when (iou < 0.02 and away > 0.22) or scale > 2.6 then null else (1 - iou) * 0.55 + away * 1.6 + (scale - 1) * 0.25 end, 6) as cost from q"""


@query(_MATCH_COST)
def match_cost(t):
    a, b = (t.v_faces.select("frame_id", F.col("face_no").alias(n), _box().alias(f"box_{n}")) for n in "ab")
    return a.join(b, "frame_id").filter("a < b").select("frame_id", "a", "b", r6(tracking.match_cost(F.col("box_a"), F.col("box_b"), (FRAME_W**2 + FRAME_H**2) ** 0.5)).alias("cost"))


def _body():
    """The body below a face, as sure as the face."""
    return boxes.body(_box(), FRAME_W, FRAME_H).withField("conf", F.col("conf"))


def frame_bodies(t):
    """A body below each face."""
    return t.v_faces.select("frame_id", _body().alias("b")).select("frame_id", "b.*")


#: Windows of a frame in shares of it, to ask what each holds.
_WINDOWS = ((1, 0.0, 0.0, 1.0, 0.5), (2, 0.0, 0.0, 0.5, 1.0), (3, 0.2, 0.2, 0.8, 0.8))
_MAP_CELLS = 24


def _map_sums_sql() -> str:
    """The importance of every cell of every frame, summed inside each window."""
    across, down = _MAP_CELLS, round(_MAP_CELLS * 1920 / 1080)
    unit = f"(1 / (1080 / {across}.0::double))"
    windows = ", ".join(f"({n}, {x1 * 1080}, {y1 * 1920}, {x2 * 1080}, {y2 * 1920})" for n, x1, y1, x2, y2 in _WINDOWS)
    kernels = ", ".join(f"({n}, {k - n // 2}, {v})" for n, values in maps.SHORT_KERNELS.items() for k, v in enumerate(values))
    edge = lambda v, most: f"least({most}, greatest(0, round_even({v} * {unit}, 0)))"
    bell = lambda lo, hi: f"case when k >= floor(({lo} + {hi}) / 2 - 3 * greatest(1, ({hi} - {lo}) * 0.55)) and k < ceil(({lo} + {hi}) / 2 + 3 * greatest(1, ({hi} - {lo}) * 0.55)) then exp(-0.5 * pow((k - ({lo} + {hi}) / 2) / greatest(1, ({hi} - {lo}) * 0.55), 2)) else 0 end"
    mirrored = lambda n: f"case when k + o < 0 then -k - o when k + o >= {n} then 2 * {n - 1} - k - o else k + o end"
    soft = lambda lo, hi, n: f"select frame_id, face_no, k, sum(case when {mirrored(n)} >= greatest(0, floor({lo})) and {mirrored(n)} < least({n}, ceil({hi})) then v else 0 end) as g from (select b.*, unnest(range(0, {n})) as k from bodies b) b join kernels on size = blur group by all"
    return f"""with f as (select frame_id, face_no, x1, y1, x2, y2, x2 - x1 as fw, y2 - y1 as fh, conf::double as conf from {{v_faces}}),
w as (select *, sqrt(greatest(fw * fh / max(fw * fh) over (partition by frame_id), 0.02)) * (0.55 + 0.45 * conf) as weight from f),
heads as (select frame_id, face_no, weight, (x1 - 0.18 * fw) * {unit} as hx1, (y1 - 0.38 * fh) * {unit} as hy1, (x2 + 0.18 * fw) * {unit} as hx2, (y2 + 0.20 * fh) * {unit} as hy2 from w),
edges as (select frame_id, face_no, 0.30 * (0.5 + 0.5 * conf) as weight, greatest(0, (x1 + x2) / 2 - 1.5 * fw) * {unit} as bx1, greatest(0, y1 - 0.35 * fh) * {unit} as by1,
  least(1080, (x1 + x2) / 2 + 1.5 * fw) * {unit} as bx2, least(1920, y2 + 3.2 * fh) * {unit} as by2 from f),
bodies as (select *, greatest(3, trunc(least(bx2 - bx1, by2 - by1) * 0.25)::int | 1) as blur from edges where bx2 > bx1 and by2 > by1),
kernels(size, o, v) as (values {kernels}),
hx as (select frame_id, face_no, weight, k, {bell("hx1", "hx2")} as g from (select *, unnest(range(0, {across})) as k from heads) h),
hy as (select frame_id, face_no, k, {bell("hy1", "hy2")} as g from (select *, unnest(range(0, {down})) as k from heads) h),
bx as ({soft("bx1", "bx2", across)}), bdy as ({soft("by1", "by2", down)}),
lit as (select x.frame_id, x.k as cx, y.k as cy, x.weight * x.g * y.g as v from hx x join hy y using (frame_id, face_no) where x.g > 0 and y.g > 0
  union all select x.frame_id, x.k, y.k, b.weight * x.g * y.g from bx x join bdy y using (frame_id, face_no) join bodies b using (frame_id, face_no) where x.g > 0 and y.g > 0),
cells as (select frame_id, cx, cy, sum(v) as v from lit group by all),
windows(crop_no, wx1, wy1, wx2, wy2) as (values {windows})
select frame_id, crop_no::bigint as crop_no, round(sum(case when cx >= {edge("wx1", across)} and cx < {edge("wx2", across)} and cy >= {edge("wy1", down)} and cy < {edge("wy2", down)} then v else 0 end) / sum(v), 6) as held
from cells, windows group by all"""


@query(_map_sums_sql())
def map_sums(t):
    """What the upper half, the left half and the middle of each frame hold of its importance: heads and bodies on a coarse map."""
    windows = F.explode(F.array(*[F.struct(F.lit(n).alias("crop_no"), *[F.lit(v * side).alias(c) for c, v, side in zip(("x1", "y1", "x2", "y2"), box, (FRAME_W, FRAME_H) * 2)]) for n, *box in _WINDOWS]))
    crops = t.v_faces.select("frame_id").distinct().select("frame_id", windows.alias("w")).select("frame_id", "w.*")
    return maps.box_shares(crops, t.v_faces, int(FRAME_W), int(FRAME_H), bodies=frame_bodies(t), cells=_MAP_CELLS).select("frame_id", "crop_no", r6("held").alias("held"))


@query()
def crop_solve(t):
    # a still's search as in the behaviour studied; it goes down to .45 where a frame has faces, which all of these have
    profile = t.v_profiles.filter("profile_id = 'feed_portrait_4x5'").first()
    zones = t.v_reserved_zones.filter("profile_id = 'feed_portrait_4x5'").orderBy("zone").collect()
    rules = crop.Rules(action=tuple(profile[f"safe_{c}"] for c in ("x1", "y1", "x2", "y2")), reserved=tuple(tuple(z[f"z{c}"] for c in ("x1", "y1", "x2", "y2")) for z in zones), least_face=0.08)
    return crop.solve(t.v_faces, int(FRAME_W), int(FRAME_H), 4 / 5, min_scale=0.45, scales=8, steps=28, rules=rules, bodies=_body())


# --- streams over the audit feed, as tables -------------------------------------------------------------------------------

@query("select time_bucket(interval 1 day, at) as window_start, action, count(*) as n, count(*) filter (where outcome = 'failure') as failures from {v_audit} group by all")
def audit_daily(t):
    return audit.rolling_counts(t.v_audit).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
