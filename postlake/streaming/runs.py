"""Streaming forms of collection, request answering and visitor counting.

Sinks are written by batch number, so a batch that is run again after a failure replaces its
own output and nothing else.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake import schemas
from postlake.operators.classify import classify_postings, route_closed, validate_postings
from postlake.operators.lifecycle import close_observations, expire_observations, expire_postings
from postlake.operators.merge import upsert_postings
from postlake.operators.normalize import normalize_postings
from postlake.operators.requests import add_counts, answer_requests, rate_counts, rate_limit, usable
from postlake.operators.visitors import day_sketches, merge_visitor_days, visitor_days
from postlake.session import cut, spread
from postlake.sources.tables import read_snapshot, snapshots, write_jobs, write_observations, write_snapshot


def once_only(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First delivery of each message of a stream ``(message_id, ts, ...)``.

    Repeats within ``delay`` of the first are dropped; the state of older messages is freed.
    """
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["message_id"])


def run_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True
):
    """Start a stream that hands each micro-batch to ``handle``."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# --- visitors --------------------------------------------------------------------------------


def visitor_stream(visits: DataFrame, root: str, checkpoint: str):
    """Keep visitor days of a stream of visits under ``root``.

    Each batch adds its own first visit per visitor and day; readers take the earliest. Beside them,
    under ``root``-sketches, it adds a sketch of each day's visitors; sketches merge, so days may come
    in any number of batches. No state is held and a late visit is never lost.
    """

    def handle(batch: DataFrame, number: int) -> None:
        days = cut(visitor_days(batch), "visitor-days")
        days.write.mode("overwrite").parquet(f"{root}/batch={number}")
        day_sketches(days).write.mode("overwrite").parquet(f"{root}-sketches/batch={number}")

    return run_batches(visits, handle, checkpoint)


def read_visitor_days(spark: SparkSession, root: str) -> DataFrame:
    days = spark.read.parquet(root).drop("batch")
    return merge_visitor_days(days, days.limit(0))


# --- postings --------------------------------------------------------------------------------


def store_entries(
    spark: SparkSession, entries: DataFrame, root: str, number: int, sources: DataFrame, as_of: dt.datetime,
    **classify,
) -> None:
    """Classify, normalise, validate and store entries, then age the tables; snapshot ``number``.

    Reads the snapshots before ``number``; repeating a number rebuilds the same ones.
    """
    jobs = read_snapshot(spark, f"{root}/jobs", schemas.JOB, number - 1)
    observations = read_snapshot(spark, f"{root}/observations", schemas.OBSERVATION, number - 1)
    entries = spread(entries, "entries")
    open_, closed = route_closed(entries)
    accepted = classify_postings(open_, **classify).where("accepted").drop("accepted", "reason", "matched_terms")
    checked = validate_postings(normalize_postings(accepted, sources, as_of))
    batch = cut(checked.withColumn("batch_seq", F.monotonically_increasing_id()), "checked")
    batch.where("NOT valid").select("source_key", "source_item_id", "title", "errors").write.mode("overwrite").parquet(
        f"{root}/quarantine/batch={number}"
    )
    gone = closed.select("source_key", F.coalesce("source_item_id", "guid").alias("source_item_id"))
    observations, jobs = close_observations(observations, jobs, gone, as_of)
    if "content_hash" not in jobs.columns:
        raise ValueError("jobs snapshot lacks content_hash")
    ranks = sources.select("source_key", "priority")
    stored = upsert_postings(jobs, observations, batch.where("valid").drop("valid", "errors"), ranks)
    aged = expire_postings(stored.jobs, as_of).drop("lifecycle_change")
    aged = cut(aged, "aged")
    write_observations(expire_observations(stored.observations, aged, as_of), f"{root}/observations", number)
    stored.counters_by_source().write.mode("overwrite").parquet(f"{root}/metrics/batch={number}")
    write_jobs(aged, f"{root}/jobs", number)


def posting_stream(
    entries: DataFrame, root: str, checkpoint: str, sources: DataFrame, as_of: Callable[[], dt.datetime], **classify
):
    """Collection as micro-batches over a stream of entries (``schemas.ENTRY``)."""

    def handle(batch: DataFrame, number: int) -> None:
        if snapshots(batch.sparkSession, f"{root}/jobs")[-1:] == [number + 1]:
            return
        store_entries(batch.sparkSession, batch, root, number + 1, sources, as_of(), **classify)

    return run_batches(entries, handle, checkpoint)


# --- requests --------------------------------------------------------------------------------


def rate_stream(
    requests: DataFrame, root: str, checkpoint: str, lateness: dt.timedelta = dt.timedelta(hours=2), **limits
):
    """Decide a stream of requests ``(request_id, visitor_hash, ts)`` by the hourly limits.

    What has been used of the recent hours is kept from batch to batch: visitors of an hour first, then
    the hour, as in `rate_limit`. Requests of an hour that is ``lateness`` behind the newest are set
    aside undecided under ``root``/late, and the counts of such hours are dropped.
    """
    form = "scope_type string, scope_key string, window_start timestamp, request_count long"

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch, "rate-batch")
        used = read_snapshot(spark, f"{root}/used", form, number)
        newest = batch.select(F.date_trunc("hour", "ts").alias("w")).union(used.select("window_start")).agg(F.max("w")).first()[0]
        first = used.agg(F.max("window_start")).first()[0]  # only what is behind earlier batches is late
        in_time = F.lit(True) if first is None else F.date_trunc("hour", "ts") >= F.lit(first - lateness)
        limited = cut(rate_limit(batch.where(in_time), used=used, **limits), "limited")
        limited.write.mode("overwrite").parquet(f"{root}/decisions/batch={number}")
        batch.where(~in_time).write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        kept = add_counts(used, rate_counts(limited))
        if newest is not None:
            kept = kept.where(F.col("window_start") >= F.lit(newest - lateness))
        write_snapshot(kept, f"{root}/used", number + 1)

    return run_batches(requests, handle, checkpoint)


def request_stream(requests: DataFrame, root: str, checkpoint: str, lateness: dt.timedelta = dt.timedelta(days=1)):
    """Answer a stream of requests ``(request_id, query_hash, ts)`` from the store under ``root``.

    Each batch writes its decisions and the next state of the store: what it has started, and of the
    older requests those that can still answer one that comes ``lateness`` after its turn. So the
    state follows the requests of about a day, not of all time.
    """
    empty = "id string, query_hash string, status string, requested_at timestamp, cache_expires_at timestamp"

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = read_snapshot(spark, f"{root}/stored", empty, number)
        batch = cut(batch, "request-batch")
        decisions, claims = answer_requests(batch, stored)
        newest = batch.agg(F.max("ts")).first()[0]
        decisions.write.mode("overwrite").parquet(f"{root}/decisions/batch={number}")
        kept = stored.unionByName(claims)
        write_snapshot(usable(kept, newest - lateness) if newest else kept, f"{root}/stored", number + 1)

    return run_batches(requests, handle, checkpoint)
