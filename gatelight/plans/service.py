"""Queries of the service surface: lookups, pages, joins by key, documents as JSON, and the small filters of the frame pipeline."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatelight.functions import sql
from gatelight.operators import rules, sequences, store, tables, tracking
from gatelight.workers import shared_folder

from .registry import query


def _r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


@query("select variant_id, asset_id, profile_id, status from {v_variants} where variant_id = 42")
def variant_by_id(t):
    return store.by_id(t.v_variants, "variant_id", 42).select("variant_id", "asset_id", "profile_id", "status")


@query("select asset_id, title, kind from {v_assets} where asset_id = 17")
def asset_by_id(t):
    return store.by_id(t.v_assets, "asset_id", 17).select("asset_id", "title", "kind")


@query("select id, \"at\", asset_id from {v_audit} where action = 'job.submitted' and asset_id = 7 order by \"at\" desc, id desc limit 50")
def jobs_page(t):
    jobs = store.audit_filter(t.v_audit, 7, "job.submitted")
    return store.page(jobs, "at", "id", 50).select("id", "at", "asset_id")


@query("select id, \"at\", action from {v_audit} where asset_id = 7 order by \"at\" desc, id desc limit 500")
def asset_audit(t):
    return store.page(store.audit_filter(t.v_audit, 7), "at", "id", 500).select("id", "at", "action")


@query("select id, action, asset_id from {v_audit} where asset_id in (select asset_id from {v_assets} where kind = 'video')")
def audit_of_videos(t):
    return store.of_assets(t.v_audit, t.v_assets.filter("kind = 'video'")).select("id", "action", "asset_id")


@query("""select a.asset_id, p.profile_id, v.variant_id from {v_assets} a join {v_profiles} p on a.kind = p.kind left join (select asset_id, profile_id, min(variant_id) as variant_id from {v_variants} group by all) v
on v.asset_id = a.asset_id and v.profile_id = p.profile_id""")
def variants_to_renew(t):
    """Each profile an asset is rendered to with the id that a re-render takes over, null where there is none yet."""
    return store.variant_ids(t.v_assets, t.v_variants, t.v_profiles)


@query("select variant_id, asset_id, profile_id, nullif(status, 'failed') as status from {v_variants}")
def json_documents(t):
    """Rows written as JSON documents and read back, nulls among them."""
    kept = t.v_variants.select("variant_id", "asset_id", "profile_id", F.nullif("status", F.lit("failed")).alias("status"))
    return store.from_document(store.document(kept, "variant_id"), kept.schema)


@query("select variant_id, 'library/' || asset_id || '/' || profile_id || case when profile_id = 'reel_vertical_9x16' then '.mp4' else '.jpg' end as key from {v_variants}")
def storage_keys(t):
    suffix = F.when(F.col("profile_id") == "reel_vertical_9x16", "mp4").otherwise("jpg")
    return t.v_variants.select("variant_id", store.library_key(F.col("asset_id"), F.col("profile_id"), suffix).alias("key"))


@query("select clip_id, i, round_even(speech, 4) as progress from {v_steps}")
def progress(t):
    return t.v_steps.select("clip_id", "i", F.bround("speech", 4).alias("progress"))


@query("select frame_id, face_no from {v_faces} where conf >= 0.6 and x2 - x1 >= 10 and y2 - y1 >= 10")
def confident_faces(t):
    return sequences.confident(t.v_faces, 0.6).select("frame_id", "face_no")


@query("select frame_id, face_no from {v_faces} where face_no % 3 = 0 or conf >= 0.85")
def confirmed_faces(t):
    return sequences.confirmed(t.v_faces.withColumn("mouth", F.when(F.col("face_no") % 3 == 0, F.lit(0.1)))).select("frame_id", "face_no")


@query("""with recursive o as materialized (select frame_id, face_no, x1, y1, x2, y2, row_number() over (partition by frame_id order by face_no) as k from {v_faces}),
f as (select frame_id, k, [{'a': x1, 'b': y1, 'c': x2, 'd': y2}] as kept, true as stays, face_no from o where k = 1
  union all select frame_id, k, case when fine then list_append(kept, {'a': x1, 'b': y1, 'c': x2, 'd': y2}) else kept end, fine, face_no from (
    select o.*, f.kept, len(list_filter(f.kept, lambda p: greatest(least(p.c, x2) - greatest(p.a, x1), 0) * greatest(least(p.d, y2) - greatest(p.b, y1), 0)
      >= 0.55 * ((p.c - p.a) * (p.d - p.b) + (x2 - x1) * (y2 - y1) - greatest(least(p.c, x2) - greatest(p.a, x1), 0) * greatest(least(p.d, y2) - greatest(p.b, y1), 0)))) = 0 as fine
    from f join o on o.frame_id = f.frame_id and o.k = f.k + 1) n)
select frame_id, face_no from f where stays""")
def distinct_persons(t):
    """Bodies in the order they were found; one that overlaps an earlier one by .55 or more is the same person."""
    from gatelight.operators import folds

    found = t.v_faces.withColumn("conf", -F.col("face_no").cast("double"))
    return folds.nms(found, overlap=0.55, inside=1.0).select("frame_id", "face_no")


@query("""with s as (select clip_id, i, candidate_track as speaker from {v_steps} where seen), d as (select clip_id, i, track, min(score) as score from {v_track_scores} where present group by all)
select s.clip_id, s.i, s.speaker, d.score from s left join d on d.clip_id = s.clip_id and d.i = s.i and d.track = s.speaker""")
def speaker_faces(t):
    """The speaker's own detection in each frame, null where the frame has none."""
    return sequences.speaker_face(t.v_steps.filter("seen").withColumnRenamed("candidate_track", "speaker"), t.v_track_scores.filter("present"), ["clip_id", "i"]).select("clip_id", "i", "speaker", "score")


@query("select clip_id, i, arg_max(track, (score, -track)) as track, max(score) as score from {v_track_scores} where present group by clip_id, i")
def best_track(t):
    return sequences.best_of_step(t.v_track_scores.filter("present"), ["clip_id", "i"], "track", "score")


@query("""with s as (select * from {v_steps} where t between 0.5 - 1e-6 and 1.5 + 1e-6)
select v.clip_id, v.i, v.track from {v_track_scores} v join s using (clip_id, i) where present""")
def slice_tracks(t):
    """The rows of a slice's steps, of tracks seen in it."""
    from gatelight.operators import asof

    steps = asof.time_slice(t.v_steps, "t", 0.5, 1.5).select("clip_id", "i")
    rows = t.v_track_scores.filter("present").join(steps, ["clip_id", "i"], "left_semi")
    return rows.select("clip_id", "i", "track")


@query("""with w as (select clip_id, track, min(i) as first_i, max(i) as last_i from {v_track_scores} where present group by all)
select s.clip_id, s.i, w.track from {v_steps} s join w on w.clip_id = s.clip_id and s.i between w.first_i and w.last_i""")
def presence(t):
    """A track is present from its first detection to its last, seen or not in between."""
    seen = t.v_track_scores.filter("present").join(t.v_steps.select("clip_id", "i", "t"), ["clip_id", "i"])
    return sequences.presence(t.v_steps, seen, "clip_id", "track").select("clip_id", "i", "track")


@query("""with w as (select clip_id, i, speech, lag(speech) over o as b, lead(speech) over o as a, count(*) over (partition by clip_id) as n from {v_steps} window o as (partition by clip_id order by i))
select clip_id, i, round(case when n < 5 then speech else 0.25 * coalesce(b, 0) + 0.5 * speech + 0.25 * coalesce(a, 0) end, 6) as smooth from w""")
def hann_speech(t):
    return sequences.hann(t.v_steps, "speech", 5).select("clip_id", "i", _r6("smooth").alias("smooth"))


@query("""with h as (select clip_id, i, sum(low_corr::int) over (partition by clip_id order by i) as s from {v_steps})
select clip_id, i, coalesce((s <> lag(s) over (partition by clip_id order by i))::int, 0) as cut from h""")
def cut_marks(t):
    return sequences.cut_marks(sequences.shot_ids(t.v_steps, "low_corr"), "shot_id").select("clip_id", "i", "cut")


@query("""select clip_id, i, round(case when hi - lo < 1e-8 then 0 else (mouth - lo) / (hi - lo) end, 6)::double as level from (select *, min(mouth) over (partition by clip_id) as lo, max(mouth) over (partition by clip_id) as hi from {v_steps})""")
def min_max(t):
    return sequences.min_max(t.v_steps, "mouth", ["clip_id"]).select("clip_id", "i", _r6("level").alias("level"))


@query("""with d as (select clip_id, i, candidate_track, low_corr, abs(cx - lag(cx) over (partition by clip_id order by i)) as d from {v_steps})
select clip_id, round(coalesce(sum(d), 0), 6)::double as travel, count(*) filter (where low_corr) as cuts, count(distinct candidate_track) as speakers from d group by clip_id""")
def path_summary(t):
    return sequences.path_summary(t.v_steps, "cx", "low_corr", "candidate_track").select("clip_id", _r6("travel").alias("travel"), "cuts", "speakers")


@query("""with a as (select frame_id, face_no, (x2 - x1) * (y2 - y1) as g, conf, greatest(least(x2 + 0.18 * (x2 - x1), 1080) - greatest(x1 - 0.18 * (x2 - x1), 0), 0) * greatest(least(y2 + 0.20 * (y2 - y1), 1920) - greatest(y1 - 0.38 * (y2 - y1), 0), 0) as head from {v_faces}),
w as (select *, sqrt(greatest(g / max(g) over (partition by frame_id), 0.02)) * (0.55 + 0.45 * conf) as weight from a)
select frame_id, arg_max(face_no, (round(weight * head, 4), -face_no)) as face_no from w group by frame_id""")
def primary_subject(t):
    return sequences.primary_subject(t.v_faces, 1080.0, 1920.0)


@query("""select frame_id, face_no, round(sqrt(greatest(g / max(g) over (partition by frame_id), 0.02)) * (0.55 + 0.45 * conf) * case when face_no = 1 then 2.2 else 1 + 0.8 * (face_no % 3) / 4.0::double end, 12) as weight
from (select *, (x2 - x1) * (y2 - y1) as g from {v_faces})""")
def face_weights(t):
    w = sequences.face_weight(t.v_faces, speaking=F.col("face_no") % 3 / 4, is_speaker=F.col("face_no") == 1)
    return w.select("frame_id", "face_no", F.round("weight", 12).alias("weight"))


@query("""select u.id, u.asset_id, case when a.asset_id is null then 'rejected' else 'queued' end as status
from {v_audit} u left join {v_assets} a on a.asset_id = u.asset_id where u.action = 'job.submitted'""")
def submitted_jobs(t):
    return store.submit(store.audit_filter(t.v_audit, None, "job.submitted"), t.v_assets).select("id", "asset_id", "status")


@query("""with f as (select asset_id, action, min({'at': "at", 'id': id}) as first from {v_audit} group by all)
select asset_id, row_number() over (partition by asset_id order by first)::int as place, action from f""")
def first_actions(t):
    """What happened to each asset, each action once, in order of its first time."""
    return sequences.first_mentions(t.v_audit, "asset_id", ["at", "id"], "action")


_TRACKS = """with w as (select clip_id, track as track_id, count(*) as hits, min(i) as first_frame, max(i) as last_frame from {v_track_scores} where present group by all),
l as (select *, max(last_frame) over (partition by clip_id) - last_frame <= 6 as live from w)"""


@query(_TRACKS + " select clip_id, track_id, hits, first_frame, last_frame from l where live or hits >= 2")
def all_tracks(t):
    """Live tracks (seen in the last six steps of their clip) and retired ones of two hits or more, as one table."""
    seen = t.v_track_scores.filter("present").groupBy("clip_id", F.col("track").alias("track_id"))
    found = seen.agg(F.count("*").alias("hits"), F.min("i").alias("first_frame"), F.max("i").alias("last_frame"))
    marked = found.withColumn("live", F.max("last_frame").over(Window.partitionBy("clip_id")) - F.col("last_frame") <= tracking.MAX_MISSES)
    return tracking.all_tracks(marked.filter("live"), marked.filter(~F.col("live") & (F.col("hits") >= tracking.MIN_HITS)), "clip_id")


@query("""with p as (select a.frame_id, a.face_no as a, b.face_no as b, (a.x2 - a.x1) * (a.y2 - a.y1) as ga, (b.x2 - b.x1) * (b.y2 - b.y1) as gb,
  greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as common
  from {v_faces} a join {v_faces} b on a.frame_id = b.frame_id and a.face_no < b.face_no)
select frame_id, a, b, round(common / (ga + gb - common), 6) as iou, round(common / ga, 6) as inside from p where common > 0""")
def sql_boxes(t):
    """Overlapping faces of a frame, asked in SQL with the box functions of the session."""
    spark = t.v_faces.sparkSession
    sql.register(spark)
    boxed = t.v_faces.selectExpr("frame_id", "face_no", "named_struct('x1', x1, 'y1', y1, 'x2', x2, 'y2', y2) as box")
    return spark.sql("""select a.frame_id, a.face_no as a, b.face_no as b, round(box_iou(a.box, b.box), 6) as iou, round(box_contained(a.box, b.box), 6) as inside
      from {faces} a join {faces} b on a.frame_id = b.frame_id and a.face_no < b.face_no where box_common(a.box, b.box) > 0""", faces=boxed)


@query("select id, at, action, asset_id from {v_audit} where at >= timestamp '2024-01-20' - interval 10 day")
def purged_table(t):
    """The audit table as stored by day, after retention has rewritten the days it touches."""
    table = tables.StoredTable(t._spark, shared_folder(t._spark), ["day"])
    table.create(t.v_audit.select("id", "at", "action", "asset_id", F.to_date("at").alias("day")))
    tables.purge(table, "at", F.lit(dt.datetime(2024, 1, 10)).cast("timestamp_ntz"))
    return table.read().select("id", "at", "action", "asset_id")


@query("""select asset_id, profile_id, arg_max(variant_id, (created_at, variant_id)) as variant_id, arg_max(status, (created_at, variant_id)) as status, max(created_at) as created_at from {v_variants} group by asset_id, profile_id""")
def upserted_table(t):
    """Variants as stored by profile: those of the first years, then the later ones put in their place."""
    columns = ("asset_id", "profile_id", "variant_id", "status", "created_at")
    table = tables.StoredTable(t._spark, shared_folder(t._spark), ["profile_id"])
    early = F.col("created_at") < F.lit(dt.datetime(1996, 1, 1)).cast("timestamp_ntz")
    rows = t.v_variants.select(*columns)
    table.create(store.upsert_latest(rows.filter(early), ["asset_id", "profile_id"], "created_at", "variant_id"))
    table.upsert(rows.filter(~early), ["asset_id", "profile_id"], "created_at", "variant_id")
    return table.read().select(*columns)


@query("select variant_id, asset_id, profile_id, status from {v_variants} v where not exists (select 1 from {v_assets} a where a.asset_id = v.asset_id and a.kind = 'video')")
def cascaded_table(t):
    """Variants as stored by profile, after the videos' assets have been deleted along with theirs."""
    columns = ("variant_id", "asset_id", "profile_id", "status")
    table = tables.StoredTable(t._spark, shared_folder(t._spark), ["profile_id"])
    table.create(t.v_variants.select(*columns))
    table.delete_keys(t.v_assets.filter("kind = 'video'"), "asset_id")
    return table.read().select(*columns)
