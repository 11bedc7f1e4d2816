"""Visitor counts and first and last sightings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visitor_days(visits: DataFrame) -> DataFrame:
    """One row per visitor and UTC day of ``visits(visitor_id, ts)``, with the first visit.

    A visitor is kept as the hash of its id.
    """
    return visits.groupBy(
        F.to_date("ts").alias("visit_date"),
        F.sha2(F.col("visitor_id").cast("string"), 256).alias("visitor_hash"),
    ).agg(F.min("ts").alias("first_seen_at"))


def visitor_upsert(days: DataFrame) -> DataFrame:
    """Visitors from their days. Later visits of a day are not written, so the last sighting is
    the first visit of the last day."""
    return days.groupBy("visitor_hash").agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("first_seen_at").alias("last_seen_at")
    )


def merge_visitor_days(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored days with new ones added; the earlier first visit stays."""
    return (
        stored.unionByName(fresh)
        .groupBy("visit_date", "visitor_hash")
        .agg(F.min("first_seen_at").alias("first_seen_at"))
    )


def visitor_counts(visits: DataFrame, day: dt.date, approximate: bool = False) -> DataFrame:
    """One row: distinct visitors in all and on ``day``; approximate counts on request."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    visitor = F.col("visitor_id")
    return visits.agg(
        distinct(visitor).alias("total_visitors"),
        distinct(F.when(F.to_date("ts") == F.lit(day), visitor)).alias("today_visitors"),
    )


def visitor_counts_by_day(visits: DataFrame) -> DataFrame:
    return visitor_days(visits).groupBy("visit_date").agg(F.count("*").alias("visitors"))


#: Accuracy of a sketch: 2^12 registers, a standard error of 1.6 %; small sets are counted exactly.
SKETCH_BITS = 12


def day_sketches(days: DataFrame) -> DataFrame:
    """A mergeable sketch of each day's visitors, from ``days(visit_date, visitor_hash)``."""
    return days.groupBy("visit_date").agg(F.hll_sketch_agg("visitor_hash", SKETCH_BITS).alias("sketch"))


def range_counts(sketches: DataFrame, ranges: DataFrame) -> DataFrame:
    """(first_day, last_day, visitors): about how many visitors came in each of ``ranges``.

    ``sketches(visit_date, sketch)`` may hold several rows for one day. They are merged by day once, and
    every range reads its days by an equi-join; no visit is looked at.
    """
    by_day = sketches.groupBy("visit_date").agg(F.hll_union_agg("sketch").alias("sketch"))
    days = ranges.select("first_day", "last_day", F.explode(F.sequence("first_day", "last_day")).alias("visit_date"))
    seen = days.join(by_day, "visit_date").groupBy("first_day", "last_day").agg(F.hll_union_agg("sketch").alias("sketch"))
    counts = seen.select("first_day", "last_day", F.hll_sketch_estimate("sketch").alias("visitors"))
    return ranges.select("first_day", "last_day").distinct().join(counts, ["first_day", "last_day"], "left").select(
        "first_day", "last_day", F.coalesce("visitors", F.lit(0).cast("long")).alias("visitors")
    )


def exact_range_counts(days: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same from the visitor days themselves, exactly.

    In a range a visitor counts at the first of its days there, whose day before lies ahead of the range.
    So visitor days are counted once by day and by the visitor's day before, and ranges read these counts.
    """
    seen = days.where("visitor_hash IS NOT NULL").select("visit_date", "visitor_hash").distinct()
    before = F.lag("visit_date").over(Window.partitionBy("visitor_hash").orderBy("visit_date"))
    steps = seen.withColumn("before", before).groupBy("visit_date", "before").agg(F.count("*").alias("n"))
    wanted = ranges.select("first_day", "last_day").distinct()
    own = wanted.select("first_day", "last_day", F.explode(F.sequence("first_day", "last_day")).alias("visit_date"))
    first = own.join(steps, "visit_date").where("before IS NULL OR before < first_day")
    counts = first.groupBy("first_day", "last_day").agg(F.sum("n").alias("exact"))
    return wanted.join(counts, ["first_day", "last_day"], "left").select(
        "first_day", "last_day", F.coalesce("exact", F.lit(0).cast("long")).alias("exact")
    )
