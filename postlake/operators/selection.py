"""Chosen postings of a profile: add with a limit, remove, clear, reconcile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake import rules
from postlake.functions.text import strip

def _clean(df: DataFrame, column: str = "job_id") -> DataFrame:
    return df.withColumn(column, strip(F.coalesce(column, F.lit(""))))


def selected(events: DataFrame, maximum: int = rules.MAX_COMPARED) -> DataFrame:
    """First ``maximum`` distinct postings each profile added: ``profile_id, job_id, pos, seq``."""
    first = (
        _clean(events)
        .where(F.col("job_id") != "")
        .groupBy("profile_id", "job_id")
        .agg(F.min("seq").alias("seq"))
    )
    order = Window.partitionBy("profile_id").orderBy("seq")
    return first.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= maximum)


def select_positions(events: DataFrame, maximum: int = rules.MAX_COMPARED) -> DataFrame:
    """Status of every add event ``(profile_id, seq, job_id)``.

    Within a profile: ``invalid`` for a blank id, ``added`` for the first event of each of
    the first ``maximum`` distinct ids, ``duplicate`` for their later events, ``limit`` for
    any other. The rank filter is applied before the shuffle, so a profile that owns a third
    of the events ships three rows per task.
    """
    kept = selected(events, maximum).select("profile_id", "job_id", F.col("seq").alias("added_seq"))
    rows = _clean(events).join(kept, ["profile_id", "job_id"], "left")
    status = (
        F.when(F.col("job_id") == "", "invalid")
        .when(F.col("seq") == F.col("added_seq"), "added")
        .when(F.col("added_seq").isNotNull(), "duplicate")
        .otherwise("limit")
    )
    return rows.select("profile_id", "seq", "job_id", status.alias("status"))


def remove_positions(selection: DataFrame, removals: DataFrame) -> DataFrame:
    """Selection without the removed ``(profile_id, job_id)``."""
    return selection.join(_clean(removals).select("profile_id", "job_id"), ["profile_id", "job_id"], "left_anti")


def clear_positions(selection: DataFrame, cleared: DataFrame) -> DataFrame:
    """Selection without the profiles in ``cleared(profile_id)``."""
    return selection.join(cleared.select("profile_id"), "profile_id", "left_anti")


def reconcile_selection(selection: DataFrame, jobs: DataFrame) -> DataFrame:
    """Saved ids, distinct and in their order, that still exist: ``profile_id, pos, job_id``."""
    distinct = (
        _clean(selection)
        .where(F.col("job_id") != "")
        .groupBy("profile_id", "job_id")
        .agg(F.min("pos").alias("pos"))
    )
    ids = jobs.select(strip(F.col("id")).alias("job_id"))
    return distinct.join(ids, "job_id", "left_semi").select("profile_id", "pos", "job_id")


def saved_only(jobs: DataFrame, selection: DataFrame) -> DataFrame:
    """Postings that the selection names."""
    saved = _clean(selection).select("job_id")
    return jobs.join(saved, strip(F.col("id")) == F.col("job_id"), "left_semi")
