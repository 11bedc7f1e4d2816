"""Books of collection runs and of on-demand requests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import rules

SUMMED = (
    "items_received", "items_accepted", "items_rejected", "jobs_inserted", "jobs_updated",
    "jobs_unchanged", "jobs_expired",
)


def _is(*statuses: str) -> Column:
    return F.col("status").isin(*statuses)


def run_state() -> Column:
    """Status of a run from its source runs; an aggregate over ``status``."""
    open_ = F.bool_or(~_is(*rules.CLOSED_STATUSES))
    return (
        F.when(F.count("status") == 0, "skipped")
        .when(open_, "running")
        .when(F.bool_and(_is("success")), "success")
        .when(F.bool_or(_is("success", "partial")), "partial")
        .when(F.bool_and(_is("skipped")), "skipped")
        .otherwise("failed")
    )


def run_status(runs: DataFrame, source_runs: DataFrame) -> DataFrame:
    """``run_id, status`` for every run of ``runs(run_id)``, also those without source runs."""
    states = source_runs.groupBy(F.col("collection_run_id").alias("run_id")).agg(run_state().alias("status"))
    return runs.select("run_id").join(states, "run_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("skipped"))
    )


def run_totals(source_runs: DataFrame) -> DataFrame:
    """Totals of closed runs. Only ``success`` counts as succeeded here; ``partial`` does not.

    The summary lists source statuses by source. A run has one source run per registered
    source, so the list is as short as the source dimension.
    """
    statuses = F.transform(
        F.sort_array(F.collect_list(F.struct("source_key", "status"))), lambda x: x["status"]
    )
    totals = source_runs.groupBy(F.col("collection_run_id").alias("run_id")).agg(
        run_state().alias("status"),
        F.count("*").alias("sources_attempted"),
        F.count_if(_is("success")).alias("sources_succeeded"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in SUMMED],
        F.count_if(F.coalesce("error_code", F.lit("")) != "").alias("error_count"),
        statuses.alias("statuses"),
    )
    summary = F.to_json(
        F.struct(
            F.col("statuses").alias("sourceStatuses"), F.lit("source-run-aggregate").alias("finalizedBy")
        )
    )
    return totals.where(F.col("status") != "running").withColumn("summary_json", summary).drop("statuses")


def collection_totals(source_results: DataFrame) -> DataFrame:
    """Totals of direct runs: success if all sources succeeded, partial if some, else failed."""
    ok = F.count_if(_is("success"))
    n = F.count("*")
    return source_results.groupBy("run_id").agg(
        n.alias("sources_attempted"),
        ok.alias("sources_succeeded"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in SUMMED],
        F.count_if(_is("failed")).alias("error_count"),
        F.when(ok == n, "success").when(ok > 0, "partial").otherwise("failed").alias("status"),
    )


def batch_metrics(entries: DataFrame, actions: DataFrame, lifecycle: DataFrame | None = None) -> DataFrame:
    """Metrics per source of one batch.

    ``entries(source_key, disposition)`` with closed, rejected, skipped or accepted;
    ``actions`` as from ``upsert_postings``; ``lifecycle(source_key, lifecycle_change)``.
    """
    got = entries.groupBy("source_key").agg(
        F.count_if(F.col("disposition") != "skipped").alias("received"),
        F.count_if(F.col("disposition") == "accepted").alias("accepted"),
        F.count_if(F.col("disposition") == "rejected").alias("rejected"),
        F.count_if(F.col("disposition") == "skipped").alias("skipped"),
        F.count_if(F.col("disposition") == "closed").alias("closed"),
    )
    stored = actions.groupBy("source_key").agg(
        F.count_if(F.col("outcome") == "inserted").alias("inserted"),
        F.count_if(F.col("outcome") == "updated").alias("updated"),
        F.count_if(F.col("outcome") == "unchanged").alias("unchanged"),
        F.count_if("cross").alias("duplicates_merged"),
    )
    rows = got.join(stored, "source_key", "full_outer")
    numbers = ["received", "accepted", "rejected", "skipped", "closed", "inserted", "updated", "unchanged", "duplicates_merged"]
    if lifecycle is not None:
        aged = lifecycle.groupBy("source_key").agg(
            F.count_if(F.col("lifecycle_change") == "expired").alias("aged_out"),
            F.count_if(F.col("lifecycle_change") == "stale").alias("stale"),
        )
        rows = rows.join(aged, "source_key", "full_outer")
        numbers += ["aged_out", "stale"]
    else:
        rows = rows.withColumns({"aged_out": F.lit(0).cast("long"), "stale": F.lit(0).cast("long")})
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in numbers})
    return rows.withColumn("expired", F.col("closed") + F.col("aged_out")).withColumn(
        "status", F.when((F.col("skipped") > 0) & (F.col("accepted") > 0), "partial").otherwise("success")
    ).drop("closed", "aged_out", "skipped")


def request_status(
    requests: DataFrame, source_runs: DataFrame, matches: DataFrame, as_of: dt.datetime
) -> DataFrame:
    """Status and counters of open requests; closed ones stay as they are.

    ``matches(id, matching_jobs)`` holds the number of postings that answer each request.
    """
    reliable = _is("success", "partial") | (_is("skipped") & F.coalesce(F.col("mode_used") == "recent-cache", F.lit(False)))
    failure = _is("failed", "dead_lettered") | (_is("skipped") & ~F.coalesce(F.col("mode_used") == "recent-cache", F.lit(False)))
    sums = source_runs.groupBy("collection_run_id").agg(
        F.count("*").alias("n"),
        F.count_if(_is(*rules.CLOSED_STATUSES)).alias("closed"),
        F.count_if(reliable).alias("reliable"),
        F.count_if(failure).alias("failures"),
        F.sum(F.coalesce("jobs_inserted", F.lit(0))).alias("inserted"),
    )
    rows = requests.join(sums, "collection_run_id", "left").join(
        matches.select("id", F.col("matching_jobs").alias("found")), "id", "left"
    )
    zero = F.lit(0).cast("long")
    count = lambda c: F.coalesce(c, zero)
    expected = F.greatest(F.coalesce("expected_sources", F.lit(0)), F.lit(0)).cast("long")
    is_open = F.col("status").isin("queued", "running")
    waiting = (count("closed") < count("n")) | (count("n") < expected)
    uneven = (count("failures") > 0) | (count("n") != expected)
    now = F.lit(as_of)
    final = (
        F.when(count("found") > 0, F.when(uneven, "partial").otherwise("success"))
        .when(count("reliable") > 0, "no_results")
        .otherwise("failed")
    )
    status = F.when(~is_open, F.col("status")).when(waiting, "running").otherwise(final)
    rows = rows.withColumns({"__status": status, "__done": is_open & ~waiting})
    done, failed = F.col("__done"), F.col("__done") & (F.col("__status") == "failed")
    changed = {
        "status": F.col("__status"),
        "started_at": F.when(
            is_open, F.coalesce("started_at", F.when(waiting, now).otherwise(F.col("requested_at")))
        ).otherwise(F.col("started_at")),
        "finished_at": F.when(done, now).otherwise(F.col("finished_at")),
        "cache_expires_at": F.when(failed, now)
        .when(done, now + F.expr(f"INTERVAL {rules.CACHE_HOURS} HOURS"))
        .otherwise(F.col("cache_expires_at")),
        "completed_sources": F.when(is_open, F.least(count("closed"), expected)).otherwise(F.col("completed_sources")),
        "sources_succeeded": F.when(is_open, F.least(count("reliable"), expected)).otherwise(F.col("sources_succeeded")),
        "jobs_inserted": F.when(is_open, count("inserted")).otherwise(F.col("jobs_inserted")),
        "matching_jobs": F.when(done, count("found")).otherwise(F.col("matching_jobs")),
        "error_code": F.when(failed, "REFRESH_FAILED").when(done, None).otherwise(F.col("error_code")),
    }
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in requests.columns])


def status_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def sources_per_job(observations: DataFrame) -> DataFrame:
    return observations.groupBy("job_id").agg(F.count("*").alias("n"))
