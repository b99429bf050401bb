"""Changes to stored tables: what is rewritten, what is counted, and what a repetition does."""

import datetime as dt
from pathlib import Path

import pytest
from gatelight.operators import revalidation, rules, tables
from gatelight.plans import gate, spec
from gatelight.plans.sheet import SHEET
from pyspark.sql import functions as F


def rows_of(table):
    return sorted(map(tuple, table.read().select("day", "kind", "id", "at", "status").collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    rows = [(dt.date(2024, 1, 1 + i % 5), ["a", "b/c", None][i % 3], i, dt.datetime(2024, 1, 1 + i % 5, i % 24), "new") for i in range(60)]
    out = tables.StoredTable(spark, str(tmp_path / "events"), ["day", "kind"])
    out.create(spark.createDataFrame(rows, "day date, kind string, id long, at timestamp_ntz, status string"))
    return out


def files(table):
    return {p: p.stat().st_mtime_ns for p in Path(table.path).rglob("*.parquet")}


def test_retention_rewrites_what_it_touches(table):
    before, held = files(table), rows_of(table)
    cut = dt.datetime(2024, 1, 2, 12)
    assert tables.purge(table, "at", F.lit(cut)) == sum(r[3] < cut for r in held)
    assert rows_of(table) == [r for r in held if r[3] >= cut]
    after = files(table)
    assert {p for p in before if "day=2024-01-01" not in str(p) and "day=2024-01-02" not in str(p)} == {p for p in after if p in before and before[p] == after[p]}
    assert not list(Path(table.path).glob("day=2024-01-01/*"))
    assert tables.purge(table, "at", F.lit(cut)) == 0 and files(table) == after  # a repeat changes nothing
    assert not [p for p in Path(table.path).parent.iterdir() if "staging" in p.name]


def test_cascade_deletes_by_key(table, spark):
    held, before = rows_of(table), files(table)
    doomed = spark.createDataFrame([(3,), (3,), (18,), (None,), (999,)], "id long")
    assert table.delete_keys(doomed, "id") == 2
    assert rows_of(table) == [r for r in held if r[2] not in (3, 18)]
    assert len({p for p in before if p in files(table)}) == len({p.parent for p in before}) - 1 or len(before) > 15  # both rows lie in one partition
    assert table.delete_keys(doomed, "id") == 0


def test_a_null_condition_deletes_nothing(table):
    held = rows_of(table)
    assert table.delete(F.col("kind") == "nothing") == 0 and table.delete(F.lit(None).cast("boolean")) == 0
    assert rows_of(table) == held


def test_upsert_inserts_updates_and_moves(table, spark):
    held = {r[2]: r for r in rows_of(table)}
    day = dt.date(2024, 1, 1)
    new = [
        (day, "a", 0, dt.datetime(2024, 3, 1), "done"), (day, "a", 0, dt.datetime(2024, 2, 1), "older"), (dt.date(2024, 2, 2), None, 7, dt.datetime(2024, 3, 1), "moved"),
        (day, "b/c", 1000, dt.datetime(2024, 3, 1), "fresh"), (held[9][0], held[9][1], 9, dt.datetime(2023, 1, 1), "late news"),
    ]
    came = spark.createDataFrame(new, "day date, kind string, id long, at timestamp_ntz, status string")
    assert table.upsert(came, ["id"], "at", "status") == {"inserted": 1, "updated": 2}
    want = held | {0: new[0], 7: new[2], 1000: new[3]}
    assert rows_of(table) == sorted(want.values(), key=repr)
    assert table.upsert(came, ["id"], "at", "status")["inserted"] == 0 and rows_of(table) == sorted(want.values(), key=repr)


def test_only_rules_with_changed_limits_are_judged_again(spark, sf_dir):
    from gatelight.plans import views

    old, new = (spec.profile_table(spark, s) for s in (SHEET, gate.newer_sheet()))
    changed = {(r.profile_id, r.rule_id) for r in revalidation.changed_rules(old, new, [*revalidation.LIMITS, "own.rule"]).collect()}
    profiles = {p["id"] for p in SHEET["profiles"]}
    assert {p for p, r in changed if r == "own.rule"} == profiles  # of unknown limits: always
    images = {p["id"] for p in SHEET["profiles"] if p["kind"] == "image"}
    assert {x for x in changed if x[1] != "own.rule"} == {(p, "tech.file_size") for p in images} | {(p, "quality.sharpness") for p in images - {"video_still_16x9"}}
    t = views.Tables(spark, sf_dir)
    facts = gate.facts(t, False, gate.newer_sheet())
    whole = {(r.media_id, r.rule_id): (r.outcome, r.severity) for r in rules.evaluate(facts, ["media_id"], rules.all_rules(facts.columns), ()).collect()}
    found = revalidation.revalidate(gate.facts(t, False, gate.newer_sheet()), gate.results(t), old, new, rules.all_rules).collect()
    assert {(r.media_id, r.rule_id): (r.outcome, r.severity) for r in found if r.outcome is not None} == whole
    held = {(r.media_id, r.rule_id): r.outcome for r in gate.results(t).collect()}
    assert {(r.media_id, r.rule_id): r.was for r in found if r.was is not None} == held


def test_a_rule_that_no_longer_applies_has_no_outcome(spark):
    sheet = {"profiles": [{**SHEET["profiles"][4]}], "defaults": SHEET["defaults"]}
    open_ = {"profiles": [{k: v for k, v in SHEET["profiles"][4].items() if k != "fps_range"}], "defaults": SHEET["defaults"]}
    old, new = spec.profile_table(spark, sheet), spec.profile_table(spark, open_)
    media = spark.createDataFrame([(1, "reel_vertical_9x16", 1080, 1920, 5.0)], "media_id long, profile_id string, width int, height int, fps double")
    held = rules.evaluate(rules.with_profile(media, old), ["media_id"], rules.technical_rules(media.columns), ())
    out = revalidation.revalidate(rules.with_profile(media, new), held, old, new, rules.technical_rules)
    assert {r.rule_id: (r.was, r.outcome) for r in out.collect()}["tech.frame_rate"] == ("fail", None)
    assert [tuple(r) for r in revalidation.flips(out).collect()] == [(1, "fail", "pass", "tech.frame_rate")]


def test_flips_count_faces_once_for_both_sheets(spark, sf_dir):
    from gatelight.plans.registry import QUERIES
    from gatelight.plans.views import Tables

    t = Tables(spark, sf_dir)
    old, new = (spec.profile_table(spark, s) for s in (SHEET, gate.newer_sheet()))
    ordered = lambda df: df.orderBy("media_id").select(*sorted(df.columns)).collect()
    swapped = rules.under_sheet(gate.facts(t, False), old, new)
    assert ordered(swapped) == ordered(gate.facts(t, False, gate.newer_sheet()))
    assert rules.under_sheet(gate.facts(t, False), old, new.withColumn("frame_fraction", F.lit(0.5))) is None
    assert rules.under_sheet(gate.facts(t, False), old.limit(1), new) is None
    plan = QUERIES["revalidation_flips"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan  # faces are read from the facts that are written
