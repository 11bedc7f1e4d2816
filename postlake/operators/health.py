"""Which sources are due, how healthy they are, where failures go."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import rules


def due_sources(sources: DataFrame, state: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Sources with ``due``: enabled, not held, and last active an interval ago or never.

    ``state(source_key, last_attempt_at, last_success_at, next_allowed_at)``.
    """
    hours = F.lit(rules.COLLECTION_HOURS["daily"])
    for name, value in rules.COLLECTION_HOURS.items():
        hours = F.when(F.col("collection_interval") == name, value).otherwise(hours)
    now = F.lit(as_of)
    last = F.greatest("last_attempt_at", "last_success_at")
    held = F.coalesce(F.col("next_allowed_at") > now, F.lit(False))
    waited = F.unix_micros(now) - F.unix_micros(last) >= hours.cast("long") * 3_600_000_000
    rows = sources.join(
        state.select("source_key", "last_attempt_at", "last_success_at", "next_allowed_at"), "source_key", "left"
    )
    return rows.withColumns(
        {
            "last_activity_at": last,
            "due": F.coalesce("enabled", F.lit(False)) & ~held & F.coalesce(waited, F.lit(True)),
        }
    )


def backoff(failures: Column, at: Column, policy: Column) -> Column:
    """Until when a source is held after so many failures in a row."""
    hold = F.lit(None).cast("timestamp")
    for least, hours in reversed(rules.BACKOFF_HOURS):
        hold = F.when(failures >= least, at + F.expr(f"INTERVAL {hours} HOURS")).otherwise(hold)
    return F.when(policy, F.lit(rules.POLICY_HOLD).cast("timestamp")).otherwise(hold)


def source_health(history: DataFrame) -> DataFrame:
    """State per source from its attempts
    ``(source_key, ts, attempt_id, ok, etag, last_modified, code, retryable)``.

    The failure streak is the number of attempts after the last success, so two aggregates
    with partial sums give it; no source's history is put in order in one task.
    """
    at = F.struct("ts", "attempt_id")
    ok = F.col("ok")
    policy = (
        ~ok & F.col("code").isin(*rules.POLICY_CODES) & ~F.coalesce("retryable", F.lit(False))
    )
    last = history.groupBy("source_key").agg(
        F.max("ts").alias("last_attempt_at"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success_at"),
        F.max(F.when(ok, at)).alias("__good"),
        F.max_by("ok", at).alias("__ok"),
        F.max_by(F.coalesce(policy, F.lit(False)), at).alias("__policy"),
        F.max_by("etag", F.when(ok & F.col("etag").isNotNull(), at)).alias("etag"),
        F.max_by("last_modified", F.when(ok & F.col("last_modified").isNotNull(), at)).alias("last_modified"),
    )
    streaks = (
        history.where(~ok)
        .join(last.select("source_key", "__good"), "source_key")
        .where(F.col("__good").isNull() | (at > F.col("__good")))
        .groupBy("source_key")
        .agg(F.count("*").alias("consecutive_failures"))
    )
    rows = last.join(streaks, "source_key", "left").withColumn(
        "consecutive_failures", F.coalesce("consecutive_failures", F.lit(0).cast("long"))
    )
    hold = backoff(F.col("consecutive_failures"), F.col("last_attempt_at"), F.col("__policy"))
    return rows.select(
        "source_key", "last_attempt_at", "last_success_at",
        F.when(F.col("__ok"), "success").otherwise("failed").alias("last_status"),
        "etag", "last_modified", "consecutive_failures",
        F.when(~F.col("__ok"), hold).alias("next_allowed_at"),
    )


def refresh_choice(state: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Whether an on-demand refresh may reach each source: ``mode`` is NULL if it may."""
    now = F.lit(as_of)
    held = F.coalesce(F.col("next_allowed_at") > now, F.lit(False))
    policy = F.col("next_allowed_at") >= F.lit("9999-01-01").cast("timestamp")
    fresh = F.coalesce(
        F.col("last_success_at") > now - F.expr(f"INTERVAL {rules.REFRESH_COOLDOWN_MINUTES} MINUTES"), F.lit(False)
    )
    mode = F.when(held & policy, "policy-pause").when(held, "backoff").when(fresh, "recent-cache")
    return state.withColumns(
        {
            "mode": mode,
            "eligible": mode.isNull(),
            "reliable": F.coalesce(mode == "recent-cache", F.lit(False)),
            "code": F.when(mode == "policy-pause", "SOURCE_POLICY_PAUSED").when(mode == "backoff", "SOURCE_BACKOFF"),
        }
    )


def failure_route(failures: DataFrame) -> DataFrame:
    """Where each failed attempt ``(attempts, retryable, code, message)`` goes.

    Adds ``temporary``, ``route`` (running, failed, dead_lettered) and ``retry_after`` seconds.
    """
    temporary = (
        F.when(F.col("retryable"), True)
        .when(~F.col("retryable"), False)
        .when(F.col("code").isin(*rules.PERMANENT_CODES), False)
        .otherwise(~F.coalesce("message", F.lit("")).rlike(rules.PERMANENT_MESSAGE))
    )
    rows = failures.withColumn("temporary", temporary)
    route = (
        F.when(~F.col("temporary"), "failed")
        .when(F.col("attempts") >= rules.MAX_ATTEMPTS, "dead_lettered")
        .otherwise("running")
    )
    index = F.least(F.greatest(F.col("attempts") - 1, F.lit(0)), F.lit(len(rules.RETRY_SECONDS) - 1))
    delay = F.array(*[F.lit(s) for s in rules.RETRY_SECONDS])[index.cast("int")]
    return rows.withColumn("route", route).withColumn(
        "retry_after", F.when(F.col("route") == "running", delay)
    )
