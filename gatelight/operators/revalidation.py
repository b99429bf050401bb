"""Decisions under a sheet that changes: versions with validity, which sheet a decision was made by, and judging again only what a newer sheet changes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatelight.operators import rules


def valid_times(versions: DataFrame, at: str = "valid_from") -> DataFrame:
    """Sheet versions (one row per version and profile) plus ``valid_to``, when the profile's next version begins; null for the one in force."""
    return versions.withColumn("valid_to", F.lead(at).over(Window.partitionBy("profile_id").orderBy(at)))


def decided_by(decisions: DataFrame, versions: DataFrame, at: str = "decided_at") -> DataFrame:
    """``decisions`` (with profile_id and a time) plus ``version``: the sheet's in force then, null before the first. Versions are few rows, as sheets change by hand."""
    spans = valid_times(versions).select(F.col("profile_id").alias("_p"), "version", "valid_from", "valid_to")
    inside = (F.col("profile_id") == F.col("_p")) & (F.col(at) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return decisions.join(F.broadcast(spans), inside, "left").drop("_p", "valid_from", "valid_to")


#: The sheet's columns that each rule looks at; a rule that is not listed is judged again whatever changes.
LIMITS = {
    "tech.dimensions": ("want_w", "want_h"), "tech.aspect_ratio": ("ratio_value",), "tech.container_codec": ("want_container", "want_video_codec", "want_pix_fmt"),
    "tech.audio": ("want_audio_codec", "want_channels", "want_rate"), "tech.frame_rate": ("fps_lo", "fps_hi"), "tech.duration": ("duration_lo", "duration_hi"),
    "tech.bitrate": ("bitrate_lo", "bitrate_hi"), "tech.file_size": ("max_mb",), "quality.letterbox": ("max_letterbox",), "quality.sharpness": ("min_sharpness",), "quality.luminance": ("luma_lo", "luma_hi"),
    "subject.face_integrity": ("clip_tolerance", "relative_size", "frame_fraction"), "subject.presence": ("require_subject", "max_absence", "min_coverage"),
    "subject.safe_zone": ("action", "relative_size", "frame_fraction"), "subject.reserved_zone": ("reserved", "relative_size", "frame_fraction"),
    "subject.reframe_motion": ("max_static",), "subject.active_speaker": ("min_speaker",), "subject.crop_provenance": (),
}


def changed_rules(old: DataFrame, new: DataFrame, rule_ids: list[str]) -> DataFrame:
    """profile_id and rule_id of the rules whose limits differ between two sheets (``spec.profile_table`` columns); rules without listed limits always."""
    columns = [c for c in old.columns if c != "profile_id"]
    both = old.select("profile_id", F.struct(*columns).alias("o")).join(new.select("profile_id", F.struct(*columns).alias("n")), "profile_id")
    unlike = lambda cs: reduce(lambda a, c: a | ~F.col("o")[c].eqNullSafe(F.col("n")[c]), cs, F.lit(False))
    marks = F.array(*[F.when(unlike(("kind", *LIMITS[r])) if r in LIMITS else F.lit(True), F.lit(r)) for r in rule_ids])
    return both.select("profile_id", F.explode(F.array_compact(marks)).alias("rule_id"))


def revalidate(facts: DataFrame, held: DataFrame, old: DataFrame, new: DataFrame, rules_of: Callable[[list[str]], list[rules.Rule]], key: str = "media_id") -> DataFrame:
    """Results under a ``new`` sheet: key, rule_id, outcome, severity, and ``was`` and ``was_severity`` under the ``old`` one (null where the rule did not apply).

    ``held`` are results under the old sheet (key, rule_id, outcome, severity), ``facts`` rows as of ``rules.gathered`` under the new one, with profile_id. Of media whose profile
    has a changed limit the changed rules are judged again; everything else is taken over from ``held``.
    """
    judged = rules_of(facts.columns)
    changed = changed_rules(old, new, [r.id for r in judged])
    per_profile = F.broadcast(changed.groupBy("profile_id").agg(F.collect_set("rule_id").alias("_again")))  # a row per profile
    due = facts.join(per_profile, "profile_id")
    again = [rules.Rule(r.id, r.severity, r.applies & F.array_contains("_again", r.id), r.outcome) for r in judged]
    fresh = rules.evaluate(due, [key], again, details=())
    kept = held.select(key, "rule_id", F.col("outcome").alias("was"), F.col("severity").alias("was_severity"))
    named = facts.select(key, "profile_id").join(per_profile, "profile_id").select(F.col(key).alias("_key"), "_again")
    kept = kept.join(named, F.col(key) == F.col("_key"), "left").withColumn("_redo", F.coalesce(F.array_contains("_again", F.col("rule_id")), F.lit(False)))
    stays = kept.filter(~F.col("_redo")).select(key, "rule_id", F.col("was").alias("outcome"), F.col("was_severity").alias("severity"), "was", "was_severity")
    before = kept.filter("_redo").select(F.col(key).alias("_k"), F.col("rule_id").alias("_r"), "was", "was_severity")
    redone = fresh.join(before, (F.col(key) == F.col("_k")) & (F.col("rule_id") == F.col("_r")), "full")
    redone = redone.select(F.coalesce(F.col(key), F.col("_k")).alias(key), F.coalesce("rule_id", "_r").alias("rule_id"), "outcome", "severity", "was", "was_severity")
    return stays.unionByName(redone)


def flips(results: DataFrame, key: str = "media_id") -> DataFrame:
    """Media whose verdict changes: key, old and new verdict, and the rules whose outcome differs, in order. ``results`` as of ``revalidate``."""
    blocked = lambda outcome, severity: F.coalesce(F.bool_or((F.col(outcome) == rules.FAIL) & (F.col(severity) == "error")), F.lit(False))
    differs = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("outcome").eqNullSafe(F.col("was")), F.col("rule_id")))), ",")
    out = results.groupBy(key).agg(blocked("was", "was_severity").alias("o"), blocked("outcome", "severity").alias("n"), differs.alias("rules"))
    verdict = lambda c: F.when(F.col(c), rules.FAIL).otherwise(rules.PASS)
    return out.filter(F.col("o") != F.col("n")).select(key, verdict("o").alias("old_verdict"), verdict("n").alias("new_verdict"), "rules")
