"""Relational views over the driver's tables that stand in for assets, variants, audit events, media, detections and steps.

The texts run in Spark and in DuckDB alike: ``{name}`` is a table or another view, ``{string}`` the engine's text type.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PROFILE_OF = """case {0} % 6 when 0 then 'hero_landscape_16x9' when 1 then 'social_square_1x1' when 2 then 'story_vertical_9x16'
    when 3 then 'feed_portrait_4x5' when 4 then 'reel_vertical_9x16' else 'video_still_16x9' end"""

VIEWS = {
    "v_profiles": """select profile_id, ratio, kind, width, height, cast(safe_x1 as double) as safe_x1, cast(safe_y1 as double) as safe_y1,
  cast(safe_x2 as double) as safe_x2, cast(safe_y2 as double) as safe_y2, cast(min_sharpness as double) as min_sharpness
from (values
 ('hero_landscape_16x9','16:9','image',1920,1080,0.04,0.04,0.96,0.96,45.0),
 ('social_square_1x1','1:1','image',1080,1080,0.05,0.05,0.95,0.95,45.0),
 ('story_vertical_9x16','9:16','image',1080,1920,0.05,0.14,0.95,0.84,45.0),
 ('feed_portrait_4x5','4:5','image',1080,1350,0.05,0.06,0.95,0.94,45.0),
 ('reel_vertical_9x16','9:16','video',1080,1920,0.05,0.14,0.95,0.84,6.0),
 ('video_still_16x9','16:9','image',1920,1080,0.04,0.04,0.96,0.96,60.0)
) as p(profile_id, ratio, kind, width, height, safe_x1, safe_y1, safe_x2, safe_y2, min_sharpness)""",
    "v_reserved_zones": """select profile_id, zone, cast(zx1 as double) as zx1, cast(zy1 as double) as zy1, cast(zx2 as double) as zx2, cast(zy2 as double) as zy2
from (values
 ('story_vertical_9x16','top_chrome',0.00,0.00,1.00,0.12),
 ('story_vertical_9x16','bottom_chrome',0.00,0.86,1.00,1.00),
 ('story_vertical_9x16','action_rail',0.82,0.55,1.00,0.86),
 ('reel_vertical_9x16','top_chrome',0.00,0.00,1.00,0.12),
 ('reel_vertical_9x16','bottom_chrome',0.00,0.86,1.00,1.00),
 ('reel_vertical_9x16','action_rail',0.82,0.55,1.00,0.86)
) as z(profile_id, zone, zx1, zy1, zx2, zy2)""",
    "v_assets": """select c.c_custkey as asset_id, c.c_name as title,
  case when c.c_mktsegment in ('MACHINERY','AUTOMOBILE') then 'video' else 'image' end as kind, o.created_at
from {customer} c left join (select o_custkey, min(o_orderdate) as created_at from {orders} group by o_custkey) o on c.c_custkey = o.o_custkey""",
    "v_variants": f"""select o_orderkey as variant_id, o_custkey as asset_id, {_PROFILE_OF.format("o_orderkey")} as profile_id,
  case o_orderstatus when 'F' then 'published' when 'O' then 'quarantined' else 'failed' end as status, o_orderdate as created_at
from {{orders}}""",
    "v_audit": """select event_id as id, ts as at,
  case event_type when 'signup' then 'asset.uploaded' when 'click' then 'job.submitted' when 'view' then 'variant.published'
    when 'error' then 'variant.quarantined' else 'job.succeeded' end as action,
  case when event_type = 'error' then 'failure' else 'success' end as outcome,
  user_id as asset_id, cast(event_id % 6 as int) as profile_no, '10.0.0.' || cast(user_id % 250 as {string}) as peer,
  case event_id % 5 when 0 then null
    when 1 then '198.51.100.' || cast(user_id % 250 as {string})
    when 2 then '1.2.3.4, 198.51.100.' || cast(user_id % 250 as {string}) || ':51234'
    when 3 then 'not-an-ip, <script>'
    else '[2001:db8::1]:443, 70.132.0.9' end as x_forwarded_for
from {events}""",
    "v_faces": """select frame_id, face_no, conf, size_px, cx - size_px*0.4 as x1, cy - size_px*0.5 as y1, cx + size_px*0.4 as x2, cy + size_px*0.5 as y2
from (select l_orderkey as frame_id,
    cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as face_no,
    0.55 + l_discount*4 as conf, 40 + 9*l_quantity as size_px,
    cast((l_partkey*37) % 1080 as double) as cx, cast((l_suppkey*113 + l_partkey) % 1920 as double) as cy
  from {lineitem}) f""",
    "v_steps": """select user_id as clip_id, i, cast(i as double) / 10 as t, event_type = 'view' as seen,
  event_type = 'error' as low_corr, cast(event_id % 3 as int) + 1 as candidate_track,
  least(value / 60, cast(1 as double)) as speech, value as mouth, cast((event_id*37) % 1280 as double) as cx,
  cast((event_id*53) % 720 as double) as cy
from (select *, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as i from {events}) e""",
    "v_track_scores": """select clip_id, i, track, cast((cast(cx as int) * track + cast(cy as int)) % 100 as double) / 100 as score, (cast(cx as int) + track) % 5 <> 0 as present
from (select clip_id, i, cx, cy, 1 as track from {v_steps} union all select clip_id, i, cx, cy, 2 as track from {v_steps} union all select clip_id, i, cx, cy, 3 as track from {v_steps}) s""",
    "v_media": f"""select m.media_id, m.profile_id, cast(p.width - case when m.sz > 45 then 2*m.sz else 0 end as int) as width, p.height,
  case when m.media_id % 41 <> 0 then cast(15 + m.sz as double) end as fps, case when m.media_id % 43 <> 0 then cast(m.sz as double)*2 end as duration_s,
  case when m.media_id % 47 <> 0 then m.price*4 end as bitrate_kbps, cast(m.price*100000 as bigint) as size_bytes,
  case when m.media_id % 19 = 0 then 'matroska,webm' else 'mov,mp4,m4a,3gp,3g2,mj2' end as container, case when m.media_id % 23 = 0 then 'hevc' else 'H264' end as video_codec,
  case when m.media_id % 29 = 0 then null when m.media_id % 31 = 0 then 'yuv420p10le' else 'yuv420p' end as pix_fmt,
  case when m.media_id % 11 = 0 then null when m.media_id % 7 = 0 then 'mp3' else 'aac' end as audio_codec,
  case when m.media_id % 13 = 0 then 1 else 2 end as audio_channels, case when m.media_id % 17 = 0 then null when m.media_id % 37 = 0 then 44100 else 48000 end as audio_rate,
  m.price % 100 as sharpness
from (select p_partkey as media_id, p_size as sz, p_retailprice as price, {_PROFILE_OF.format("p_partkey")} as profile_id from {{part}}) m
  join {{v_profiles}} p on m.profile_id = p.profile_id""",
    "v_samples": """select l_partkey as media_id, cast(l_linenumber as int) as sample, cast(l_linenumber as double) * 0.4 as t,
  count(case when l_returnflag <> 'R' and l_partkey % 5 <> 0 then 1 end) as faces, max(l_tax) / 7.5 as letterbox, avg(l_quantity) * 5 as luma, max(l_extendedprice) / 700 as sharpness
from {lineitem} where l_partkey % 17 <> 0 group by l_partkey, l_linenumber""",
    "v_media_faces": """select media_id, sample, t, face_no, conf, cx - s*0.4 as x1, cy - s*0.5 as y1, cx + s*0.4 as x2, cy + s*0.5 as y2
from (select l_partkey as media_id, cast(l_linenumber as int) as sample, cast(l_linenumber as double) * 0.4 as t,
    cast(row_number() over (partition by l_partkey, l_linenumber order by l_orderkey, l_suppkey, l_quantity, l_extendedprice) as int) as face_no,
    0.55 + l_discount*4 as conf, 30 + case when l_partkey % 3 = 0 then 1 else 7 end * l_quantity as s,
    cast(case when l_partkey % 3 = 0 then 300 + (l_suppkey*31) % 480 else (l_partkey*37 + l_suppkey*211) % 1080 end as double) as cx,
    cast(case when l_partkey % 3 = 0 then 500 + (l_suppkey*17) % 300 else (l_suppkey*113 + l_orderkey*7) % 1350 end as double) as cy
  from {lineitem} where l_returnflag <> 'R' and l_partkey % 5 <> 0 and l_partkey % 17 <> 0) f""",
    "v_hints": """select p_partkey as media_id, p_partkey % 9 <> 0 as source_has_faces,
  case when p_partkey % 10 <> 3 then cast((p_partkey * 7) % 41 as double) / 40 end as moving_fraction, cast(p_size as double) / 400 - 0.005 as total_travel,
  case when p_partkey % 8 <> 1 then cast(p_partkey % 30 as double) / 250 end as subject_motion, cast((p_partkey * 3) % 25 as int) as speech_steps,
  case when p_partkey % 14 <> 5 then cast(60 + p_size % 41 as double) / 100 end as speaker_coverage,
  case when p_partkey % 6 <> 5 then cast(p_partkey % 20 as double) / 250 end as subject_offset, cast(p_size % 12 as double) / 500 as crop_offset
from {part}""",
}


def needs(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{([a-z]\w*)\}", sql)) - {"string"})


class Tables:
    """Driver tables and views of one folder, loaded when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in VIEWS:
            sql = VIEWS[name].replace("{string}", "string")
            df = self._spark.sql(sql, **{n: getattr(self, n) for n in needs(sql)})
        else:
            df = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        setattr(self, name, df)
        return df


def oracle(sql: str) -> str:
    """DuckDB statement with the views it uses written out as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in needs(text):
            if n in VIEWS and n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(sql)
    def plain(text: str) -> str:
        named = re.sub(r"\{([a-z]\w*)\}", lambda m: "varchar" if m[1] == "string" else m[1], text)
        return re.sub(r"(?<![\w\"'])at(?![\w\"'])", '"at"', named)  # a reserved word there

    body = plain(sql).strip()
    if not order:
        return body
    ctes = ", ".join(f"{n} as ({plain(VIEWS[n])})" for n in order)
    if body[:5].lower() == "with ":
        rest = body[5:]
        recursive = rest[:10].lower() == "recursive "
        return f"with {'recursive ' if recursive else ''}{ctes}, {rest[10:] if recursive else rest}"
    return f"with {ctes} {body}"
