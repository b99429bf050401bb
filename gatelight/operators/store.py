"""Metadata store: filters, paging, rollups, retention, cascades and upserts over assets, variants and audit events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def library(variants: DataFrame) -> DataFrame:
    return variants.filter(F.col("status") == "published")


def variants_of_asset(variants: DataFrame, asset_id) -> DataFrame:
    return variants.filter(F.col("asset_id") == asset_id).orderBy("created_at", "variant_id")


def variant_lookup(variants: DataFrame, asset_id, profile_id: str) -> DataFrame:
    return variants.filter((F.col("asset_id") == asset_id) & (F.col("profile_id") == profile_id)).orderBy("created_at", "variant_id").limit(1)


def page(df: DataFrame, at: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """Newest first, ties by key descending; a page costs its offset plus its limit."""
    return df.orderBy(F.desc(at), F.desc(key)).offset(offset).limit(limit)


def audit_filter(audit: DataFrame, asset_id=None, action: str | None = None) -> DataFrame:
    """A filter that is not given adds no predicate."""
    if asset_id is not None:
        audit = audit.filter(F.col("asset_id") == asset_id)
    return audit if action is None else audit.filter(F.col("action") == action)


def asset_rollup(assets: DataFrame, variants: DataFrame) -> DataFrame:
    """Every asset with its variant counts, 0 where it has none. Variants are reduced before the join."""
    counts = variants.groupBy("asset_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "published").alias("p"))
    joined = assets.join(counts, "asset_id", "left")
    n, p = (F.coalesce(F.col(c), F.lit(0)) for c in "np")
    return joined.select("asset_id", "title", "kind", n.alias("variants"), p.alias("published"), (n - p).alias("not_published"))


def retention(events: DataFrame, now: dt.datetime, days: int, at: str = "at") -> tuple[DataFrame, DataFrame]:
    """(kept, count purged as one row). ``days`` of 0 or less keeps everything. The caller writes the kept rows over the partition."""
    old = F.lit(False) if days <= 0 else F.col(at) < F.lit(now - dt.timedelta(days=days)).cast("timestamp_ntz")
    return events.filter(~old), events.agg(F.count_if(old).alias("purged"))


def cascade_delete(assets: DataFrame, variants: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets and variants without those of ``doomed`` (asset_id); jobs and audit events are not touched."""
    return assets.join(doomed, "asset_id", "left_anti"), variants.join(doomed, "asset_id", "left_anti")


def upsert_latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The latest row per key, by one aggregate with map-side combine (no sort, no window)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def latest_active_job(jobs: DataFrame, active: list[str]) -> DataFrame:
    """Per asset its newest job in one of the ``active`` states."""
    return upsert_latest(jobs.filter(F.col("action").isin(*active)), ["asset_id"], "at", "id")


def unrendered_profiles(assets: DataFrame, variants: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles an asset's kind offers and no variant of it has; the profile sheet is a few rows."""
    offered = assets.select("asset_id", "kind").join(F.broadcast(profiles.select("profile_id", "kind")), "kind")
    return offered.join(variants.select("asset_id", "profile_id").distinct(), ["asset_id", "profile_id"], "left_anti").select("asset_id", "profile_id")


def job_counts(variants: DataFrame) -> DataFrame:
    return variants.groupBy("asset_id").agg(F.count("*").alias("variants"), F.count_if(F.col("status") == "published").alias("published"), F.count_if(F.col("status") != "published").alias("quarantined"))


def first_last_times(events: DataFrame) -> DataFrame:
    """Per asset when work first ran and last ended: the times a job's marks would carry."""
    started = F.min(F.when(F.col("action") == "job.submitted", F.col("at")))
    ended = F.max(F.when(F.col("action").isin("job.succeeded", "variant.quarantined"), F.col("at")))
    return events.groupBy("asset_id").agg(started.alias("started_at"), ended.alias("finished_at"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def decision_audit(gated: DataFrame, key: str) -> DataFrame:
    """One audit row per gate decision."""
    action = F.concat(F.lit("variant."), F.col("status"))
    return gated.select(F.col(key), action.alias("action"), F.when(F.col("status") == "published", "success").otherwise("failure").alias("outcome"), F.to_json(F.struct("failing", "warned")).alias("detail"))


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The row of an id; none if there is none."""
    return df.filter(F.col(key) == value).limit(1)


def of_assets(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Jobs or audit events of the given assets, by the value of asset_id."""
    return events.join(assets.select("asset_id"), "asset_id", "left_semi")


def variant_ids(assets: DataFrame, variants: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per asset and profile of its kind the variant id that a re-render takes over (the first one given), null where there is none."""
    held = variants.groupBy("asset_id", "profile_id").agg(F.min("variant_id").alias("variant_id"))
    offered = assets.select("asset_id", "kind").join(F.broadcast(profiles.select("profile_id", "kind")), "kind")
    return offered.join(held, ["asset_id", "profile_id"], "left").select("asset_id", "profile_id", "variant_id")


def document(df: DataFrame, key: str) -> DataFrame:
    """Rows as JSON documents under their key."""
    return df.select(F.col(key).alias("id"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("doc"))


def from_document(docs: DataFrame, schema) -> DataFrame:
    """Documents back as rows of ``schema``."""
    return docs.select(F.from_json("doc", schema).alias("r")).select("r.*")


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, one file per partition."""
    df.write.mode("overwrite").json(path)


def library_key(asset, profile, suffix):
    return F.concat(F.concat_ws("/", F.lit("library"), asset.cast("string"), profile), F.lit("."), suffix)


def master_key(asset, suffix):
    return F.concat(F.concat_ws("/", F.lit("masters"), asset.cast("string")), F.lit("."), suffix)


def submit(requests: DataFrame, assets: DataFrame, key: str = "asset_id") -> DataFrame:
    """Job requests with their first status: queued, or rejected where their asset is unknown (or null)."""
    known = assets.select(key).distinct().withColumn("_known", F.lit(True))
    return requests.join(known, key, "left").withColumn("status", F.when(F.col("_known"), "queued").otherwise("rejected")).drop("_known")


def record(events: DataFrame, path: str) -> bool:
    """Append audit events; False, with a warning, if that failed: an audit must never stop the work it describes."""
    import warnings

    try:
        events.write.mode("append").parquet(path)
        return True
    except Exception as error:
        warnings.warn(f"audit not recorded: {error}", stacklevel=2)
        return False


def diagnostics(variants: DataFrame, results: DataFrame, audit: DataFrame, key: str = "asset_id") -> DataFrame:
    """Per asset a short text report: its variants by status, its failed rules, and how many audit events it has.

    ``results`` has the key, rule_id and outcome. All three tables are reduced per asset before they are joined.
    """
    v = variants.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "published").alias("p"))
    r = results.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("outcome") == "fail", F.col("rule_id")))), ", ").alias("failed"))
    a = audit.groupBy(key).agg(F.count("*").alias("events"))
    joined = v.join(r, key, "left").join(a, key, "left")
    lines = F.concat_ws(
        "\n", F.format_string("# asset %s", F.col(key).cast("string")), F.format_string("%d variant(s), %d published", "n", "p"),
        F.concat(F.lit("failed rules: "), F.when(F.coalesce(F.col("failed"), F.lit("")) == "", "none").otherwise(F.col("failed"))), F.format_string("%d audit event(s)", F.coalesce("events", F.lit(0))),
    )
    return joined.select(key, lines.alias("summary"))


def write_diagnostics(reports: DataFrame, path: str, key: str = "asset_id") -> None:
    """Reports as text documents, a folder for each asset; a repeat replaces the folders of the assets it holds, and no others."""
    reports.select(key, "summary").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n\n").partitionBy(key).text(path)
