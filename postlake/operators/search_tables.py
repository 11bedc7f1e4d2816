"""Counting the matches of a table of search requests.

The cost follows the postings, the requests and what they find, not their product: keywords are found
through `containing`, postings are reduced to counts by the fields that requests compare, and
requests meet those counts by equi-joins alone.
"""

from __future__ import annotations

import datetime as dt
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import rules
from postlake.functions.grams import containing
from postlake.functions.text import strip
from postlake.operators.search import normalize_filter_rows, not_past, public_dataset
from postlake.session import cut

#: How far off a deadline is, and the classes each option takes in.
CLASSES = {"d7": (0, 7), "d30": (8, 30), "d60": (31, 60)}
OPTIONS = {
    "any": ("d7", "d30", "d60", "later", "unstated"),
    "7": ("d7",),
    "30": ("d7", "d30"),
    "60": ("d7", "d30", "d60"),
    "open": ("d7", "d30", "d60", "later"),
    "none": ("unstated",),
}


def _searched() -> Column:
    """All fields a keyword may stand in, told apart by a character no keyword holds."""
    fields = [F.to_json(c) if c == "tags" else F.col(c) for c in rules.SEARCHED_COLUMNS]
    return F.concat_ws("\n", *[F.lower(F.coalesce(f, F.lit(""))) for f in fields])


def _class(deadline: Column, as_of: dt.date) -> Column:
    left = F.datediff(deadline, F.lit(as_of))
    out = F.when(deadline.isNull(), "unstated")
    for name, (first, last) in CLASSES.items():
        out = out.when(left.between(first, last), name)
    return out.otherwise("later")


def search_requests(jobs: DataFrame, requests: DataFrame, as_of: dt.date) -> DataFrame:
    """(request_id, matching_jobs) for every row of ``requests`` (request_id, filters...), zeros kept.

    Filters are normalised as stored requests are. Requests that ask for the same are counted once.
    """
    rows = cut(normalize_filter_rows(requests).select("request_id", "filter_key", *rules.FILTER_LIMITS, "deadline"), "requests")
    fields = [F.lower(c).alias(c) for c in rules.FILTER_LIMITS]
    asked = cut(rows.select("filter_key", *fields, "deadline").distinct(), "asked")

    active = public_dataset(jobs, as_of).where(F.col("is_active") & not_past(as_of))
    key = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    slim = active.select(
        F.monotonically_increasing_id().alias("text_id"), key("country").alias("country"), key("research_area").alias("research_area"),
        key("language").alias("language"), _class(F.col("deadline"), as_of).alias("due"), _searched().alias("text"),
    )
    slim = cut(slim, "searched")
    facts = ["country", "research_area", "language"]
    hits = containing(slim.select("text_id", "text"), asked.select(F.col("keyword").alias("needle")))
    hits = hits.join(slim.select("text_id", *facts, "due"), "text_id").select("needle", *facts, "due")
    everything = slim.select(F.lit("").alias("needle"), *facts, "due")
    cells = hits.unionByName(everything).groupBy("needle", *facts).agg(
        *[F.count_if(F.col("due") == c).alias(c) for c in OPTIONS["any"]]
    )
    cells = cut(cells, "cells")

    # A request meets the counts by what it compares; languages stand for all stored ones that hold them.
    stored = cells.select(F.col("language").alias("text_id"), F.col("language").alias("text")).distinct()
    spoken = containing(stored, asked.select(F.col("language").alias("needle")))
    spoken = spoken.select(F.col("needle").alias("asked_language"), F.col("text_id").alias("stored_language"))
    asked = asked.join(spoken, F.col("language") == F.col("asked_language"), "left")
    asked = asked.where("language = '' OR stored_language IS NOT NULL").withColumn("language", F.coalesce("stored_language", F.lit("")))
    bits = [F.when(F.col(c) != "", 1).otherwise(0) for c in facts]
    asked = asked.withColumn("mask", F.array(*bits))
    used = {tuple(r["mask"]) for r in asked.select("mask").distinct().collect()}  # eight at most
    masks = [m for m in product((0, 1), repeat=len(facts)) if m in used]
    if not masks:
        return rows.select("request_id", F.lit(0).cast("long").alias("matching_jobs"))
    shown = F.array(*[
        F.struct(F.array(*[F.lit(b) for b in m]).alias("mask"), *[(F.col(c) if b else F.lit("")).alias(c) for b, c in zip(m, facts, strict=True)])
        for m in masks
    ])
    rolled = cells.select("needle", *OPTIONS["any"], F.explode(shown).alias("s")).select("needle", "s.*", *OPTIONS["any"])
    rolled = rolled.groupBy("needle", "mask", *facts).agg(*[F.sum(c).alias(c) for c in OPTIONS["any"]])
    met = asked.withColumnRenamed("keyword", "needle").join(rolled, ["needle", "mask", *facts])
    total = F.lit(0)
    for option, classes in OPTIONS.items():
        total = F.when(F.col("deadline") == option, sum((F.col(c) for c in classes), F.lit(0))).otherwise(total)
    counts = met.groupBy("filter_key").agg(F.sum(total).alias("matching_jobs"))
    return rows.join(counts, "filter_key", "left").select("request_id", F.coalesce("matching_jobs", F.lit(0)).alias("matching_jobs"))
