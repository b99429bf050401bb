"""Spec sheet: a YAML (or plain dict) document checked on the driver and turned into a small table that the rules read their limits from."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Limits that hold where a sheet says nothing. A sheet's defaults override them, and a profile's overrides both.
DEFAULTS = {
    "image": {"max_file_size_mb": 10.0, "min_sharpness": 40.0, "jpeg_quality": 92, "max_letterbox_fraction": 0.01, "luma_mean_range": (20.0, 240.0)},
    "video": {
        "container": "mp4", "video_codec": "h264", "pixel_format": "yuv420p", "audio_codec": "aac", "audio_channels": 2, "audio_sample_rate": 48000,
        "max_file_size_mb": 120.0, "max_letterbox_fraction": 0.01, "min_sharpness": 6.0,
    },
    "compliance": {
        "face_clip_tolerance": 0.995, "require_subject_present": True, "significant_face_relative_size": 0.45, "significant_face_frame_fraction": 0.055,
        "min_subject_frame_coverage": 0.70, "max_subject_absence_s": 1.5, "min_active_speaker_coverage": 0.80, "max_static_frames_fraction": 0.95,
    },
}


class SpecError(ValueError):
    """A sheet that contradicts itself."""


def aspect(text) -> float:
    if isinstance(text, (int, float)):
        return float(text)
    a, _, b = str(text).strip().replace(":", "/").partition("/")
    return float(a) / float(b) if b else float(a)


def zones_of(profile: dict) -> dict[str, list]:
    """Named rectangles of a profile: its action-safe area under ``action``, reserved zones under their names."""
    out = {f"reserved {z['name']}": z["rect"] for z in profile.get("reserved_zones") or []}
    action = (profile.get("safe_zones") or {}).get("action")
    return out | ({"action": action} if action else {})


def self_check(sheet: dict) -> list[str]:
    """Faults: repeated ids, sizes off their ratio by over 1 percent, render sets naming no profile, zones that are no rectangles in 0..1."""
    profiles, faults = sheet.get("profiles", []), []
    ids = [p["id"] for p in profiles]
    faults += [f"profile {i} is listed {ids.count(i)} times" for i in sorted({i for i in ids if ids.count(i) > 1})]
    for p in profiles:
        want = aspect(p["ratio"])
        if abs(p["width"] / p["height"] - want) / want > 0.01:
            faults.append(f"profile {p['id']}: {p['width']}x{p['height']} is not {p['ratio']}")
        for zone in zones_of(p).values():
            if not (len(zone) == 4 and 0 <= zone[0] < zone[2] <= 1 and 0 <= zone[1] < zone[3] <= 1):
                faults.append(f"profile {p['id']}: {zone} is no rectangle in 0..1")
    faults += [f"render set {k} names {i}, which is no profile" for k, v in sheet.get("render_sets", {}).items() for i in v if i not in ids]
    return faults


def load(path: str) -> dict:
    """A checked sheet; read again only when the file's time of change differs."""
    return _load(path, Path(path).stat().st_mtime_ns)


@lru_cache(maxsize=8)
def _load(path: str, changed: int) -> dict:
    import yaml

    sheet = yaml.safe_load(Path(path).read_text())
    if not isinstance(sheet, dict):
        raise SpecError("a sheet is a mapping at its top level")
    if faults := self_check(sheet):
        raise SpecError("; ".join(faults))
    return sheet


def settings(sheet: dict, profile: dict, group: str) -> dict:
    """Limits of a group (image, video, compliance): built in, then the sheet's defaults, then the profile's own; keys the group lacks are ignored."""
    base = dict(DEFAULTS[group])
    for layer in (sheet.get("defaults", {}).get(group) or {}, profile.get("overrides") or {}):
        base |= {k: v for k, v in layer.items() if k in base}
    return base


def profiles_of(sheet: dict, kind: str) -> list[str]:
    """The render set of a kind, or every profile of that kind where the sheet has none."""
    return list(sheet.get("render_sets", {}).get(kind) or [p["id"] for p in sheet["profiles"] if p["kind"] == kind])


_BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
_COLUMNS = f"""profile_id string, label string, ratio string, kind string, want_w int, want_h int, ratio_value double, fps_lo double, fps_hi double, duration_lo double,
  duration_hi double, bitrate_lo double, bitrate_hi double, max_mb double, min_sharpness double, max_letterbox double, luma_lo double, luma_hi double,
  want_container string, want_video_codec string, want_pix_fmt string, want_audio_codec string, want_channels int, want_rate int, clip_tolerance double,
  relative_size double, frame_fraction double, require_subject boolean, min_coverage double, max_absence double, min_speaker double, max_static double,
  action {_BOX}, reserved array<struct<name:string,rect:{_BOX}>>"""


def profile_table(spark: SparkSession, sheet: dict) -> DataFrame:
    """One row per profile with everything the rules compare against."""
    rows = []
    for p in sheet["profiles"]:
        image, video, rules = (settings(sheet, p, g) for g in ("image", "video", "compliance"))
        own = video if p["kind"] == "video" else image
        pairs = [tuple(map(float, p[k])) if p.get(k) else (None, None) for k in ("fps_range", "duration_range_s", "bitrate_kbps_range")]
        action = (p.get("safe_zones") or {}).get("action")
        reserved = [(z["name"], tuple(map(float, z["rect"]))) for z in p.get("reserved_zones") or []]
        rows.append((
            p["id"], p.get("label"), str(p["ratio"]), p["kind"], p["width"], p["height"], aspect(p["ratio"]), *pairs[0], *pairs[1], *pairs[2],
            float(own["max_file_size_mb"]), float(own["min_sharpness"]), float(own["max_letterbox_fraction"]), *map(float, image["luma_mean_range"]),
            video["container"], video["video_codec"], video["pixel_format"], video["audio_codec"], video["audio_channels"], video["audio_sample_rate"],
            rules["face_clip_tolerance"], rules["significant_face_relative_size"], rules["significant_face_frame_fraction"], rules["require_subject_present"],
            rules["min_subject_frame_coverage"], rules["max_subject_absence_s"], rules["min_active_speaker_coverage"], rules["max_static_frames_fraction"],
            tuple(map(float, action)) if action else None, reserved,
        ))
    return spark.createDataFrame(rows, _COLUMNS)


def render_table(spark: SparkSession, sheet: dict) -> DataFrame:
    """Kind and profile_id of every profile that an asset of the kind is rendered to, in the sheet's order."""
    kinds = sorted({p["kind"] for p in sheet["profiles"]} | set(sheet.get("render_sets", {})))
    rows = [(k, i, n) for k in kinds for n, i in enumerate(profiles_of(sheet, k))]
    return spark.createDataFrame(rows, T.StructType([T.StructField("kind", T.StringType()), T.StructField("profile_id", T.StringType()), T.StructField("place", T.IntegerType())]))
