"""On-demand search requests: checks, identity, reuse, limits, recovery, retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake import rules
from postlake.functions.scans import carry_last, in_ranges
from postlake.functions.text import BLANK, nfkc, strip
from postlake.operators.accounting import request_status, run_status, run_totals
from postlake.operators.search import normalize_filter_rows
from postlake.session import cut

FIELDS = tuple(rules.FILTER_LIMITS)


def validate_requests(payloads: DataFrame) -> DataFrame:
    """Add ``error_code`` (the first that applies, else NULL) to ``payloads(request_id, payload)``.

    ``payload`` is the JSON text of a request. Order of checks: field names, string values,
    length, markup or address, deadline option, at least one filter.
    """
    rows = payloads.withColumn("__v", F.try_parse_json("payload"))
    rows = rows.withColumns(
        {
            "__keys": F.json_object_keys("payload"),
            "__map": F.from_json("payload", "map<string,string>"),
        }
    )
    allowed = (*FIELDS, "deadline")
    # A text value is quoted in the JSON; anything else is not a string.
    schema = F.schema_of_variant("__v")
    not_text = schema.rlike(r": (?!STRING)[A-Z]")
    value = lambda c: F.coalesce(F.try_element_at("__map", F.lit(c)), F.lit(""))
    code = (
        F.when(F.col("__keys").isNull(), "INVALID_REQUEST")
        .when(~F.forall("__keys", lambda k: k.isin(*allowed)), "INVALID_REQUEST")
        .when(not_text, "INVALID_REQUEST")
    )
    for c in FIELDS:
        text = value(c)
        code = code.when(F.length(strip(text)) > rules.FILTER_LIMITS[c], "VALUE_TOO_LONG").when(
            text.rlike(rules.UNSAFE_FILTER), "UNSAFE_FILTER"
        )
    option = F.lower(strip(value("deadline")))
    option = F.when(option == "", "any").otherwise(option)
    empty = option == "any"
    for c in FIELDS:
        empty = empty & (strip(value(c)) == "")
    code = code.when(~option.isin(*rules.DEADLINE_OPTIONS), "INVALID_DEADLINE").when(empty, "EMPTY_FILTER")
    return rows.withColumns(
        {"error_code": code, **{c: value(c) for c in FIELDS}, "deadline": option}
    ).drop("__v", "__keys", "__map")


def split_requests(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused)."""
    return checked.where(F.col("error_code").isNull()), checked.where(F.col("error_code").isNotNull())


def query_hash(requests: DataFrame) -> DataFrame:
    """Add ``query_hash``: SHA-256 of the canonical JSON of the normalised filters."""
    order = ("country", "deadline", "keyword", "language", "research_area")
    rows = normalize_filter_rows(requests)
    flat = lambda c: F.lower(F.trim(F.regexp_replace(nfkc(F.col(c)), f"{BLANK}+", " ")))
    return rows.withColumn(
        "query_hash", F.sha2(F.to_json(F.struct(*[flat(c).alias(c) for c in order])), 256)
    ).drop("filter_key", "meaningful")


def request_reuse(incoming: DataFrame, stored: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """What answers each request of ``incoming(request_id, query_hash, ts)``.

    ``stored(id, query_hash, status, requested_at, cache_expires_at)``. ``decision`` is
    ``results_available`` if ``matches(request_id, matching_jobs)`` says so, ``active`` for a
    request under way for at most 45 minutes, ``cached`` for an unexpired answer, else
    ``new``; ``reuse_id`` names the request reused.

    A stored request is only made when nothing could be reused, so of one query the newest
    open and the newest answered request are the only candidates. Both are carried forward
    in time order, by ranges of bounded size, however often one query is asked.
    """
    open_ = F.col("status").isin("queued", "running")
    answered = F.col("status").isin("success", "partial", "no_results")
    old = stored.select(
        "query_hash",
        F.col("requested_at").alias("ts"),
        F.lit(0).alias("side"),
        F.col("id").alias("event_id"),
        F.when(open_, F.struct("id", F.col("requested_at").alias("at"))).alias("open_row"),
        F.when(answered, F.struct("id", F.col("cache_expires_at").alias("at"))).alias("answer_row"),
    )
    new = incoming.select(
        "query_hash", "ts", F.lit(1).alias("side"), F.col("request_id").alias("event_id"),
        F.lit(None).cast(old.schema["open_row"].dataType).alias("open_row"),
        F.lit(None).cast(old.schema["answer_row"].dataType).alias("answer_row"),
    )
    order = ["ts", "side", "event_id"]
    rows = in_ranges(old.unionByName(new), ["query_hash", *order], "range")
    carried = carry_last(
        rows, ["query_hash"], order, F.col("range"),
        {"last_open": "open_row", "last_answer": "answer_row"},
        include_current=True,
    ).where(F.col("side") == 1)
    active = F.coalesce(
        F.col("last_open.at") >= F.col("ts") - F.expr(f"INTERVAL {rules.ACTIVE_REUSE_MINUTES} MINUTES"),
        F.lit(False),
    )
    cached = F.coalesce(F.col("last_answer.at") > F.col("ts"), F.lit(False))
    rows = carried.select(
        F.col("event_id").alias("request_id"), "query_hash", "ts",
        F.when(active, "active").when(cached, "cached").otherwise("new").alias("decision"),
        F.when(active, F.col("last_open.id")).when(cached, F.col("last_answer.id")).alias("reuse_id"),
    )
    if matches is None:
        return rows
    hit = F.coalesce(F.col("matching_jobs") > 0, F.lit(False))
    return rows.join(matches.select("request_id", "matching_jobs"), "request_id", "left").select(
        "request_id", "query_hash", "ts",
        F.when(hit, "results_available").otherwise(F.col("decision")).alias("decision"),
        F.when(~hit, F.col("reuse_id")).alias("reuse_id"),
    )


def _claimed(open_: DataFrame) -> DataFrame:
    """The rows of ``open_(query_hash, ts, request_id)``, one for each query and time, that start a request.

    The first of a query does, and after one that does the first that comes more than 45 minutes
    later. Every row points to the one that would be next after it; pointers double their reach in
    each round, and what has been found doubles with them.
    """
    wait = rules.ACTIVE_REUSE_MINUTES * 60_000_000
    at = F.unix_micros("ts")
    found = F.struct("request_id", "ts")
    back = open_.select("query_hash", (-at).alias("back"), F.lit(1).alias("side"), "request_id", "ts", found.alias("row"))
    ask = open_.select("query_hash", (-at - wait).alias("back"), F.lit(0).alias("side"), "request_id", "ts", F.lit(None).cast(back.schema["row"].dataType).alias("row"))
    order = ["back", "side", "request_id"]
    rows = in_ranges(back.unionByName(ask), ["query_hash", *order], "range")
    ahead = carry_last(rows, ["query_hash"], order, F.col("range"), {"next": "row"}, include_current=False).where("side = 0")
    jump = cut(ahead.where("next IS NOT NULL").select("request_id", F.col("next.request_id").alias("to")), "jumps")
    chosen = cut(open_.groupBy("query_hash").agg(F.min_by("request_id", "ts").alias("request_id")).select("request_id"), "claims")
    while not jump.isEmpty():
        chosen = cut(chosen.union(chosen.join(jump, "request_id").select("to")), "claims")
        further = jump.select(F.col("request_id").alias("to"), F.col("to").alias("further"))
        jump = cut(jump.join(further, "to").select("request_id", F.col("further").alias("to")), "jumps")
    return open_.join(chosen.distinct(), "request_id", "left_semi")


def answer_requests(requests: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decide requests in time order: (decisions, new requests to store).

    What the store cannot answer starts a new request; later requests of the same query join
    it for 45 minutes. Equal to deciding one by one, in rounds whose number is the logarithm of how
    many requests one query starts.
    """
    have = ["id", "query_hash", "status", "requested_at", "cache_expires_at"]
    stored = stored.select(*have)
    slim = cut(requests.select("request_id", "query_hash", "ts"), "requests")
    unanswered = request_reuse(slim, stored).where(F.col("decision") == "new")
    first = unanswered.groupBy("query_hash", "ts").agg(F.min("request_id").alias("request_id"))
    started = cut(_claimed(cut(first, "unanswered")), "started")
    claims = started.select(
        F.col("request_id").alias("id"), "query_hash", F.lit("queued").alias("status"), F.col("ts").alias("requested_at"),
        (F.col("ts") + F.expr(f"INTERVAL {rules.CACHE_HOURS} HOURS")).alias("cache_expires_at"),
    )
    decided = request_reuse(slim, stored.unionByName(claims))
    own = F.col("reuse_id") == F.col("request_id")
    decided = decided.withColumns({"decision": F.when(own, "new").otherwise(F.col("decision")), "reuse_id": F.when(~own, F.col("reuse_id"))})
    return cut(decided, "decisions"), claims


def usable(stored: DataFrame, since: dt.datetime) -> DataFrame:
    """The stored requests that can still answer a request made at ``since`` or later."""
    now = F.lit(since)
    open_ = F.col("status").isin("queued", "running") & (F.col("requested_at") >= now - F.expr(f"INTERVAL {rules.ACTIVE_REUSE_MINUTES} MINUTES"))
    answered = F.col("status").isin("success", "partial", "no_results") & (F.col("cache_expires_at") > now)
    return stored.where(open_ | answered)


def hourly_windows(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Add the hour a row falls in and the whole seconds left of it, one at least."""
    start = F.date_trunc("hour", ts)
    left = 3600 - (F.unix_micros(F.col(ts)) - F.unix_micros(start)) / 1_000_000
    return events.withColumns(
        {"window_start": start, "retry_after": F.greatest(F.lit(1), F.ceil(left).cast("int"))}
    )


def rate_limit(
    requests: DataFrame,
    per_visitor: int = rules.VISITOR_HOURLY_LIMIT,
    overall: int = rules.GLOBAL_HOURLY_LIMIT,
    window: str = "hour",
    used: DataFrame | None = None,
) -> DataFrame:
    """Add ``allowed`` and ``retry_after`` to ``requests(request_id, visitor_hash, ts)``.

    Per UTC window a visitor's first ``per_visitor`` requests pass to the second stage, and its
    first ``overall`` are allowed; a refused request uses up nothing. Equal to deciding one
    by one: until the window is full, what a visitor has used are its first requests, and
    afterwards nothing passes. Both ranks are cut off before their shuffles, so a visitor or an
    hour with a third of all requests ships a few rows per task. ``used`` (as `rate_counts` gives it)
    is what earlier requests have taken of the windows.
    """
    rows = hourly_windows(requests) if window == "hour" else requests.withColumn(
        "window_start", F.date_trunc(window, "ts")
    )
    order = [F.col("ts"), F.col("request_id")]
    visitor = Window.partitionBy("visitor_hash", "window_start").orderBy(*order)
    everyone = Window.partitionBy("window_start").orderBy(*order)
    slim = rows.select("request_id", "visitor_hash", "window_start", "ts")
    passed = slim.withColumn("rn", F.row_number().over(visitor)).where(F.col("rn") <= per_visitor)
    taken = F.coalesce("request_count", F.lit(0))
    if used is not None:
        own = used.where("scope_type = 'visitor'").select(F.col("scope_key").alias("visitor_hash"), "window_start", "request_count")
        passed = passed.join(own, ["visitor_hash", "window_start"], "left").where(F.col("rn") + taken <= per_visitor).drop("request_count")
    passed = passed.drop("rn").withColumn("rn", F.row_number().over(everyone)).where(F.col("rn") <= overall)
    if used is not None:
        all_ = used.where("scope_type = 'global'").select("window_start", "request_count")
        passed = passed.join(all_, "window_start", "left").where(F.col("rn") + taken <= overall)
    return rows.join(
        passed.select("request_id", F.lit(True).alias("allowed")), "request_id", "left"
    ).withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def rate_counts(limited: DataFrame) -> DataFrame:
    """Used-up counts as stored: one row per scope, key and window."""
    used = limited.where(F.col("allowed"))
    visitor = used.groupBy(F.lit("visitor").alias("scope_type"), F.col("visitor_hash").alias("scope_key"), "window_start").agg(
        F.count("*").alias("request_count")
    )
    everyone = used.groupBy(
        F.lit("global").alias("scope_type"), F.lit("approved-source-search").alias("scope_key"), "window_start"
    ).agg(F.count("*").alias("request_count"))
    return visitor.unionByName(everyone)


def add_counts(used: DataFrame, more: DataFrame) -> DataFrame:
    """Counts of windows with those of a further batch."""
    keys = ["scope_type", "scope_key", "window_start"]
    return used.unionByName(more).groupBy(*keys).agg(F.sum("request_count").alias("request_count"))


def recover_stale(
    requests: DataFrame, source_runs: DataFrame, sources: DataFrame, as_of: dt.datetime,
    batch: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(stale requests, their source runs) with missing runs added as failed and open ones failed.

    Takes all open requests older than 45 minutes; with ``batch`` only the oldest so many.
    """
    cutoff = F.lit(as_of) - F.expr(f"INTERVAL {rules.ACTIVE_REUSE_MINUTES} MINUTES")
    stale = (
        requests.where(F.col("status").isin("queued", "running") & (F.col("requested_at") < cutoff))
    )
    if batch is not None:
        stale = stale.orderBy("requested_at", "id").limit(batch)
    stale = stale.withColumn(
        "collection_run_id",
        F.coalesce("collection_run_id", F.concat(F.lit("recovery-"), F.substring(F.sha2("id", 256), 1, 32))),
    )
    listed = sources.where("enabled").select(F.col("position").alias("index"), "source_key")
    expected = stale.where(F.col("expected_sources") > 0).select(
        "collection_run_id", F.explode(F.sequence(F.lit(1), F.col("expected_sources"))).alias("index")
    )
    expected = expected.join(listed, "index", "left").select(
        "collection_run_id",
        F.coalesce("source_key", F.concat(F.lit("unavailable-approved-source-"), F.col("index").cast("string"))).alias("source_key"),
    )
    own = source_runs.join(stale.select("collection_run_id"), "collection_run_id", "left_semi")
    missing = expected.join(own, ["collection_run_id", "source_key"], "left_anti")
    code = F.lit("STALE_ON_DEMAND_SEARCH")
    values = {
        "status": F.lit("failed"),
        "mode_used": F.lit("stale-recovery"),
        "error_code": code,
        "message_id": F.concat_ws("-", F.lit("recovery"), "collection_run_id", "source_key"),
    }
    added = missing.select(
        *[
            F.col(c) if c in missing.columns
            else values[c].alias(c) if c in values
            else F.lit(0 if c.startswith(("items_", "jobs_")) else None).cast(source_runs.schema[c].dataType).alias(c)
            for c in source_runs.columns
        ]
    )
    is_open = F.col("status").isin("queued", "running")
    ended = own.withColumns(
        {
            "mode_used": F.when(is_open, F.coalesce("mode_used", F.lit("stale-recovery"))).otherwise(F.col("mode_used")),
            "error_code": F.when(is_open, code).otherwise(F.col("error_code")),
            "status": F.when(is_open, "failed").otherwise(F.col("status")),
        }
    )
    return stale, ended.unionByName(added)


def close_stale(
    requests: DataFrame, source_runs: DataFrame, sources: DataFrame, matches: DataFrame, as_of: dt.datetime
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Recover stale requests and book what follows: (requests closed, their source runs, run statuses,
    run totals). ``matches(id, matching_jobs)`` as in `request_status`."""
    stale, ended = recover_stale(requests, source_runs, sources, as_of)
    stale, ended = cut(stale, "stale"), cut(ended, "ended")
    statuses = run_status(stale.select(F.col("collection_run_id").alias("run_id")), ended)
    return request_status(stale, ended, matches, as_of), ended, statuses, run_totals(ended)


def retain(requests: DataFrame, windows: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests kept, windows kept, one row of counts removed).

    Closed requests go after seven days, rate windows after 48 hours.
    """
    now = F.lit(as_of)
    closed = F.col("status").isin("success", "partial", "no_results", "failed")
    old_request = closed & (F.col("requested_at") < now - F.expr("INTERVAL 7 DAYS"))
    old_window = F.col("window_start") < now - F.expr("INTERVAL 48 HOURS")
    removed = (
        requests.select(F.when(old_request, 1).otherwise(0).alias("r"), F.lit(0).alias("w"))
        .unionByName(windows.select(F.lit(0).alias("r"), F.when(old_window, 1).otherwise(0).alias("w")))
        .agg(F.sum("r").alias("requests_deleted"), F.sum("w").alias("rate_windows_deleted"))
    )
    return requests.where(~old_request), windows.where(~old_window), removed


def first_deliveries(messages: DataFrame) -> DataFrame:
    """First delivery of each message ``(message_id, ts, ...)``."""
    values = [c for c in messages.columns if c != "message_id"]
    return (
        messages.groupBy("message_id")
        .agg(F.min_by(F.struct(*values), F.struct("ts", "delivery")).alias("m"))
        .select("message_id", "m.*")
    )

