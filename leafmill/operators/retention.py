"""Retention of jobs, results and uploads, leases, and stored assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import encode_key, percent_encode, safe_id
from .records import latest

ACTIVE = ("queued", "processing")


def job_actions(jobs: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """jobs (job_id, status, updated_at, modified_at: epoch seconds) with age and action: keep, expire (the result goes,
    the state stays), or delete (an expired state, or one that can't be read, that has aged again)."""
    age = now - F.coalesce("updated_at", "modified_at")
    old = age > settings.result_ttl_hours * 3600
    return jobs.withColumn("age", age).withColumn(
        "action", F.when(~F.coalesce(old, F.lit(False)), "keep").when(F.col("status").isNull() | (F.col("status") == "expired"), "delete").otherwise("expire")
    )


def expiry_on_read(status: Column, updated_at: Column, now: Column, settings: Settings = DEFAULTS) -> Column:
    return F.when(now - updated_at > settings.result_ttl_hours * 3600, F.lit("expired")).otherwise(status)


def orphans(results: DataFrame, jobs: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Results older than the limit whose job is gone."""
    return results.where(now - F.col("modified_at") > settings.result_ttl_hours * 3600).join(jobs.select("job_id").distinct(), "job_id", "left_anti")


def stale_uploads(uploads: DataFrame, jobs: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Old uploads whose job isn't active; an upload belongs to the job that its stem names."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    active = jobs.where(F.col("status").isin(*ACTIVE)).select(F.col("job_id").alias("__job")).distinct()
    return uploads.where(now - F.col("modified_at") > settings.stale_seconds).join(active, stem == F.col("__job"), "left_anti")


def stale_entries(entries: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    return entries.where(now - F.col("modified_at") > settings.stale_seconds)


def report(actions: DataFrame) -> DataFrame:
    return actions.agg(F.count_if(F.col("action") == "expire").alias("expired_jobs"), F.count_if(F.col("action") == "delete").alias("deleted_job_metadata"))


def expired_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") <= now)


def active_leases(leases: DataFrame, now_ms: Column, limits: dict[str, int]) -> DataFrame:
    """engine, active, limit: leases that haven't run out, for every engine that has a limit."""
    known = leases.sparkSession.createDataFrame(sorted(limits.items()), "engine string, limit int")
    counted = leases.groupBy("engine").agg(F.count_if(F.col("expires_ms") > now_ms).alias("active"))
    return known.join(counted, "engine", "left").select("engine", F.coalesce("active", F.lit(0)).alias("active"), "limit")


def concurrency(spans: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """group, at, running: how many spans run from each moment at which one starts or ends; an end counts first."""
    steps = spans.select(group, F.col(start).alias("at"), F.lit(1).alias("step")).unionByName(spans.select(group, F.col(end).alias("at"), F.lit(-1).alias("step")))
    net = steps.groupBy(group, "at").agg(F.sum("step").alias("step"))
    so_far = Window.partitionBy(group).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return net.select(group, "at", F.sum("step").over(so_far).alias("running"))


def latest_states(events: DataFrame, job: str, *newest: str) -> DataFrame:
    return latest(events, job, *newest)


def asset_rows(files: DataFrame, prefix: str, request: str = "request_id", path: str = "path") -> DataFrame:
    """files with idx (order of paths in a request), object_key, asset_id, url_path; the key holds a token column."""
    order = Window.partitionBy(request).orderBy(path)
    key = F.concat(
        F.lit(prefix + "/"), safe_id(F.col(request)), F.lit("/"), F.col("token"), F.lit("/"), F.lpad(F.col("idx").cast("string"), 4, "0"), F.lit("-"),
        F.element_at(F.split(path, "/"), -1),
    )
    return (
        files.withColumn("idx", F.row_number().over(order)).withColumn("object_key", key)
        .withColumn("asset_id", encode_key(F.col("object_key"))).withColumn("url_path", percent_encode(F.col("object_key")))
    )


def manifest_name(request: Column, token: Column) -> Column:
    return F.concat(F.lit("asset_"), F.substring(F.sha2(request, 256), 1, 24), F.lit("_"), token, F.lit(".json"))


def asset_expiry(now: Column, settings: Settings = DEFAULTS) -> Column:
    return F.lit(None).cast("timestamp") if settings.assets_public else now + F.make_interval(hours=F.lit(settings.asset_ttl_hours))


def deletable_results(assets: DataFrame, result: str = "result_id") -> DataFrame:
    """result, delete: a result goes only if every asset that it records was deleted."""
    return assets.groupBy(result).agg((F.count_if("deleted") == F.count("asset_id")).alias("delete"))


def distinct_contents(files: DataFrame, content: str, first: str) -> DataFrame:
    """One row for each content: its digest, the first file that has it, and how many have."""
    return files.groupBy(F.sha2(F.col(content), 256).alias("sha")).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"))
