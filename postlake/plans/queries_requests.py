"""Runs, source health, requests, visitors."""

import datetime as dt

from pyspark.sql import functions as F

from postlake.operators import accounting, health, match, requests, visitors
from postlake.plans.bridge import EVENTS_DAY, EVENTS_TS
from postlake.plans.queries import register, view
from postlake.schemas import REQUEST
from postlake.session import scratch_path
from postlake.sources import tables

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
NOW = f"TIMESTAMP '{EVENTS_TS}'"

RUN_STATE = """CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_and(status = 'success') THEN 'success'
  WHEN bool_or(status IN ('success', 'partial')) THEN 'partial' WHEN bool_and(status = 'skipped') THEN 'skipped' ELSE 'failed' END"""
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in accounting.SUMMED)


@register(
    "run_status", "source_runs",
    oracle=f"""WITH s AS (SELECT collection_run_id AS run_id, {RUN_STATE} AS status FROM source_runs_v GROUP BY 1)
      SELECT CAST(o_orderkey AS VARCHAR) AS run_id, coalesce(s.status, 'skipped') AS status FROM orders LEFT JOIN s ON s.run_id = CAST(o_orderkey AS VARCHAR)""",
)
def _run_status(spark, d):
    runs = view(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"))
    return accounting.run_status(runs, view(spark, d, "source_runs"))


@register(
    "run_totals", "source_runs",
    oracle=f"""SELECT * FROM (SELECT collection_run_id AS run_id, {RUN_STATE} AS status, count(*) AS sources_attempted,
        count(*) FILTER (status = 'success') AS sources_succeeded, {SUMS}, count(error_code) AS error_count,
        concat('{{"sourceStatuses":["', string_agg(status, '","' ORDER BY source_key), '"],"finalizedBy":"source-run-aggregate"}}') AS summary_json
      FROM source_runs_v GROUP BY 1) t WHERE status <> 'running'""",
)
def _run_totals(spark, d):
    return accounting.run_totals(view(spark, d, "source_runs"))


@register(
    "collection_totals", "source_runs",
    oracle=f"""SELECT collection_run_id AS run_id, count(*) AS sources_attempted, count(*) FILTER (status = 'success') AS sources_succeeded, {SUMS},
      count(*) FILTER (status = 'failed') AS error_count,
      CASE WHEN bool_and(status = 'success') THEN 'success' WHEN bool_or(status = 'success') THEN 'partial' ELSE 'failed' END AS status
      FROM source_runs_v GROUP BY 1""",
)
def _collection_totals(spark, d):
    return accounting.collection_totals(view(spark, d, "source_runs").withColumnRenamed("collection_run_id", "run_id"))


REQ_SQL = """req AS (SELECT concat('r-', CAST(o_orderkey AS VARCHAR)) AS id, CAST(o_orderkey AS VARCHAR) AS run, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'success' END AS status,
    CAST(o_orderkey % 7 AS INT) AS expected, CAST(o_orderkey % 3 AS BIGINT) AS found FROM orders),
 s AS (SELECT collection_run_id AS run, count(*) AS n, count(*) FILTER (status <> 'running') AS closed,
    count(*) FILTER (status IN ('success', 'partial') OR (status = 'skipped' AND mode_used = 'recent-cache')) AS good,
    count(*) FILTER (status = 'failed' OR (status = 'skipped' AND mode_used <> 'recent-cache')) AS bad, sum(jobs_inserted) AS ins FROM source_runs_v GROUP BY 1)"""


def _requests_of_orders(spark, d):
    orders = view(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("success")
    values = {
        "id": F.concat(F.lit("r-"), F.col("o_orderkey").cast("string")),
        "collection_run_id": F.col("o_orderkey").cast("string"),
        "status": status,
        "requested_at": F.col("o_orderdate").cast("timestamp"),
        "expected_sources": (F.col("o_orderkey") % 7).cast("int"),
    }
    types = {c.split()[0]: c.split()[1] for c in REQUEST.replace("\n", " ").split(",")}
    return orders.select(
        *[(values[c] if c in values else F.lit(None).cast(t)).alias(c) for c, t in types.items()],
        (F.col("o_orderkey") % 3).alias("matching"),
    )


@register(
    "request_status", "source_runs",
    oracle=f"""WITH {REQ_SQL}, j AS (SELECT req.*, coalesce(n, 0) AS n, coalesce(closed, 0) AS closed, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, coalesce(ins, 0) AS ins,
        req.status <> 'success' AS is_open FROM req LEFT JOIN s ON s.run = req.run),
      k AS (SELECT *, is_open AND (closed < n OR n < expected) AS waiting FROM j),
      f AS (SELECT *, CASE WHEN NOT is_open THEN status WHEN waiting THEN 'running' WHEN found > 0 THEN CASE WHEN bad > 0 OR n <> expected THEN 'partial' ELSE 'success' END
        WHEN good > 0 THEN 'no_results' ELSE 'failed' END AS st FROM k)
      SELECT id, st AS status, CASE WHEN is_open THEN CAST(least(closed, expected) AS BIGINT) END AS completed_sources,
        CASE WHEN is_open THEN CAST(least(good, expected) AS BIGINT) END AS sources_succeeded, CASE WHEN is_open THEN CAST(ins AS BIGINT) END AS jobs_inserted,
        CASE WHEN is_open AND NOT waiting THEN found END AS matching_jobs, CASE WHEN is_open AND NOT waiting AND st = 'failed' THEN 'REFRESH_FAILED' END AS error_code,
        CASE WHEN is_open AND NOT waiting THEN strftime(CASE WHEN st = 'failed' THEN {NOW} ELSE {NOW} + INTERVAL 12 HOURS END, '%Y-%m-%d %H:%M:%S') END AS cache_expires_at FROM f""",
)
def _request_status(spark, d):
    rows = _requests_of_orders(spark, d)
    matches = rows.select("id", F.col("matching").alias("matching_jobs"))
    done = accounting.request_status(rows.drop("matching"), view(spark, d, "source_runs"), matches, EVENTS_TS)
    return done.select(
        "id", "status", "completed_sources", "sources_succeeded", "jobs_inserted", "matching_jobs", "error_code", "cache_expires_at"
    )


@register(
    "link_runs", "source_runs",
    oracle=f"""WITH {REQ_SQL} SELECT r.message_id, q.id AS request_id, CASE WHEN q.id IS NULL THEN 'orphan run' WHEN q.status = 'success' THEN 'request closed' END AS reject_reason
      FROM source_runs_v r LEFT JOIN req q ON q.run = r.collection_run_id AND q.expected > 0""",
)
def _link(spark, d):
    owners = _requests_of_orders(spark, d).where("expected_sources > 0")
    return match.link_runs(owners, view(spark, d, "source_runs")).select("message_id", "request_id", "reject_reason")


# --- source health ---------------------------------------------------------------------------

HEALTH = """h AS (SELECT *, NOT ok AND code = 'ROBOTS_DISALLOWED' AND retryable IS NULL AS policy FROM history_v),
 g AS (SELECT source_key, max(ts) AS last_attempt_at, max(ts) FILTER (ok) AS last_success_at, max((ts, attempt_id)) FILTER (ok) AS good,
   arg_max(ok, (ts, attempt_id)) AS last_ok, arg_max(policy, (ts, attempt_id)) AS last_policy, arg_max(etag, (ts, attempt_id)) FILTER (ok AND etag IS NOT NULL) AS etag FROM h GROUP BY source_key),
 st AS (SELECT g.*, (SELECT count(*) FROM h WHERE h.source_key = g.source_key AND NOT h.ok AND (g.good IS NULL OR (h.ts, h.attempt_id) > g.good)) AS streak FROM g),
 state AS (SELECT *, CASE WHEN last_ok THEN NULL WHEN last_policy THEN TIMESTAMP '9999-12-31 23:59:59' WHEN streak >= 4 THEN last_attempt_at + INTERVAL 72 HOURS
   WHEN streak = 3 THEN last_attempt_at + INTERVAL 24 HOURS WHEN streak = 2 THEN last_attempt_at + INTERVAL 12 HOURS END AS next_allowed_at FROM st)"""


def _health(spark, d):
    return health.source_health(view(spark, d, "history").withColumn("last_modified", F.lit(None).cast("string")))


@register(
    "source_health", "history",
    oracle=f"""WITH {HEALTH} SELECT source_key, {TS.format('last_attempt_at')} AS last_attempt_at, {TS.format('last_success_at')} AS last_success_at,
      CASE WHEN last_ok THEN 'success' ELSE 'failed' END AS last_status, etag, streak AS consecutive_failures, {TS.format('next_allowed_at')} AS next_allowed_at FROM state""",
)
def _source_health(spark, d):
    return _health(spark, d).drop("last_modified")


@register(
    "due_sources", "history",
    oracle=f"""WITH {HEALTH} SELECT source_key, NOT coalesce(next_allowed_at > {NOW}, FALSE) AND greatest(last_attempt_at, coalesce(last_success_at, last_attempt_at)) <= {NOW}
      - CASE CAST(substr(source_key, 8) AS INT) % 4 WHEN 0 THEN INTERVAL 12 HOURS WHEN 1 THEN INTERVAL 24 HOURS WHEN 2 THEN INTERVAL 48 HOURS ELSE INTERVAL 168 HOURS END AS due FROM state""",
)
def _due(spark, d):
    state = _health(spark, d)
    turn = F.substring("source_key", 8, 20).cast("int") % 4
    interval = F.when(turn == 0, "twice_daily").when(turn == 1, "daily").when(turn == 2, "every_48_hours").otherwise("weekly")
    sources = state.select("source_key", interval.alias("collection_interval"), F.lit(True).alias("enabled"))
    return health.due_sources(sources, state, EVENTS_TS).select("source_key", "due")


@register(
    "refresh_choice", "history",
    oracle=f"""WITH {HEALTH} SELECT source_key, CASE WHEN next_allowed_at >= TIMESTAMP '9999-01-01' THEN 'policy-pause' WHEN next_allowed_at > {NOW} THEN 'backoff'
      WHEN last_success_at > {NOW} - INTERVAL 60 MINUTES THEN 'recent-cache' END AS mode FROM state""",
)
def _refresh(spark, d):
    return health.refresh_choice(_health(spark, d), EVENTS_TS).select("source_key", "mode")


@register(
    "failure_route", "history",
    oracle="""WITH t AS (SELECT *, CASE WHEN retryable THEN TRUE WHEN code IN ('ROBOTS_DISALLOWED', 'SOURCE_TOO_LARGE') THEN FALSE ELSE message <> 'Invalid configuration' END AS temporary FROM history_v WHERE NOT ok),
      r AS (SELECT *, CASE WHEN NOT temporary THEN 'failed' WHEN attempts >= 4 THEN 'dead_lettered' ELSE 'running' END AS route FROM t)
      SELECT attempt_id, route, CASE WHEN route = 'running' THEN CASE WHEN attempts <= 1 THEN 60 WHEN attempts = 2 THEN 300 ELSE 900 END END AS retry_after FROM r""",
)
def _route(spark, d):
    return health.failure_route(view(spark, d, "history").where("NOT ok")).select("attempt_id", "route", "retry_after")


# --- requests --------------------------------------------------------------------------------


def _limit(name, window, visitor, overall):
    @register(
        name, "requests",
        oracle=f"""WITH v AS (SELECT *, date_trunc('{window}', ts) AS w, row_number() OVER (PARTITION BY visitor_hash, date_trunc('{window}', ts) ORDER BY ts, request_id) AS rn FROM requests_v),
          p AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY ts, request_id) AS gn FROM v WHERE rn <= {visitor})
          SELECT r.request_id, p.request_id IS NOT NULL AS allowed FROM requests_v r LEFT JOIN p ON p.request_id = r.request_id AND p.gn <= {overall}""",
    )
    def run(spark, d):
        return requests.rate_limit(view(spark, d, "requests"), visitor, overall, window).select("request_id", "allowed")


_limit("rate_limit", "hour", 3, 20)
_limit("rate_limit_daily", "day", 3, 200)


@register(
    "rate_counts", "requests",
    oracle="""WITH v AS (SELECT *, date_trunc('hour', ts) AS w, row_number() OVER (PARTITION BY visitor_hash, date_trunc('hour', ts) ORDER BY ts, request_id) AS rn FROM requests_v),
      p AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY ts, request_id) AS gn FROM v WHERE rn <= 3), a AS (SELECT * FROM p WHERE gn <= 20)
      SELECT 'visitor' AS scope_type, visitor_hash AS scope_key, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS request_count FROM a GROUP BY ALL
      UNION ALL SELECT 'global', 'approved-source-search', strftime(w, '%Y-%m-%d %H:%M:%S'), count(*) FROM a GROUP BY ALL""",
)
def _rate_counts(spark, d):
    return requests.rate_counts(requests.rate_limit(view(spark, d, "requests")))


@register(
    "hourly_windows", "requests",
    oracle="""SELECT request_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
      CAST(greatest(1, ceil((3600000000 - (epoch_us(ts) - epoch_us(date_trunc('hour', ts)))) / 1000000.0)) AS INT) AS retry_after FROM requests_v""",
)
def _windows(spark, d):
    return requests.hourly_windows(view(spark, d, "requests")).select("request_id", "window_start", "retry_after")


@register(
    "request_reuse", "requests", "stored_requests",
    oracle="""WITH o AS (SELECT r.request_id, arg_max(s.id, (s.requested_at, s.id)) AS id, max((s.requested_at, s.id)) AS at FROM requests_v r JOIN stored_requests_v s
          ON s.query_hash = r.query_hash AND s.status = 'queued' AND s.requested_at <= r.ts GROUP BY 1),
        a AS (SELECT r.request_id, arg_max(s.id, (s.requested_at, s.id)) AS id, arg_max(s.cache_expires_at, (s.requested_at, s.id)) AS until FROM requests_v r JOIN stored_requests_v s
          ON s.query_hash = r.query_hash AND s.status IN ('success', 'no_results') AND s.requested_at <= r.ts GROUP BY 1),
        so AS (SELECT s.id, s.requested_at FROM stored_requests_v s)
      SELECT r.request_id, CASE WHEN so.requested_at >= r.ts - INTERVAL 45 MINUTES THEN 'active' WHEN a.until > r.ts THEN 'cached' ELSE 'new' END AS decision,
        CASE WHEN so.requested_at >= r.ts - INTERVAL 45 MINUTES THEN o.id WHEN a.until > r.ts THEN a.id END AS reuse_id
      FROM requests_v r LEFT JOIN o ON o.request_id = r.request_id LEFT JOIN so ON so.id = o.id LEFT JOIN a ON a.request_id = r.request_id""",
)
def _reuse(spark, d):
    rows = requests.request_reuse(view(spark, d, "requests"), view(spark, d, "stored_requests"))
    return rows.select("request_id", "decision", "reuse_id")


@register(
    "query_hash", "requests",
    oracle="""SELECT request_id, sha256(concat('{"country":"', lower(country), '","deadline":"any","keyword":"', keyword, '","language":"","research_area":""}')) AS query_hash FROM requests_v""",
)
def _query_hash(spark, d):
    rows = view(spark, d, "requests").select("request_id", F.concat(F.lit(" "), F.upper("keyword")).alias("keyword"), "country")
    return requests.query_hash(rows).select("request_id", "query_hash")


@register(
    "normalize_filters", "requests",
    oracle="""SELECT request_id, concat('{"keyword":"', keyword, '","country":"', lower(country), '","research_area":"","language":"","deadline":"', CASE WHEN value > 50 THEN '30' ELSE 'any' END, '"}') AS filter_key,
      TRUE AS meaningful FROM requests_v""",
)
def _filters(spark, d):
    from postlake.operators.search import normalize_filter_rows

    rows = view(spark, d, "requests").select(
        "request_id", F.col("keyword").alias("q"), F.concat(F.lit(" "), "country", F.lit(" ")).alias("country"),
        F.when(F.col("value") > 50, "30").otherwise("soon").alias("deadline"), F.lit(None).cast("string").alias("keyword"),
    )
    return normalize_filter_rows(rows).select("request_id", "filter_key", "meaningful")


@register(
    "validate_requests", "requests",
    oracle="""SELECT request_id, CASE WHEN value < 5 THEN 'INVALID_REQUEST' WHEN keyword = 'error' THEN 'INVALID_REQUEST' WHEN keyword = 'click' THEN 'UNSAFE_FILTER'
      WHEN value > 90 THEN 'VALUE_TOO_LONG' WHEN value > 60 THEN 'INVALID_DEADLINE' WHEN value < 10 THEN 'EMPTY_FILTER' END AS error_code FROM requests_v""",
)
def _validate(spark, d):
    rows = view(spark, d, "requests")
    v = F.col("value")
    text = F.when(v > 90, F.repeat(F.lit("x"), 151)).when(v < 10, " ").otherwise(F.col("keyword"))
    text = F.when(F.col("keyword") == "click", "see www.example.org").otherwise(text)
    deadline = F.when(v > 60, '"soon"').otherwise('""')
    key = F.when(v < 5, "word").otherwise("keyword")
    number = F.when(F.col("keyword") == "error", '7').otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    payload = F.concat(F.lit('{"'), key, F.lit('":'), number, F.lit(',"deadline":'), deadline, F.lit("}"))
    return requests.validate_requests(rows.select("request_id", payload.alias("payload"))).select("request_id", "error_code")


@register(
    "retain", "stored_requests", "requests",
    oracle=f"""SELECT (SELECT count(*) FROM stored_requests_v WHERE status <> 'queued' AND requested_at < {NOW} - INTERVAL 7 DAYS) AS requests_deleted,
      (SELECT count(*) FROM requests_v WHERE date_trunc('hour', ts) < {NOW} - INTERVAL 48 HOURS) AS rate_windows_deleted""",
)
def _retain(spark, d):
    windows = requests.hourly_windows(view(spark, d, "requests"))
    return requests.retain(view(spark, d, "stored_requests"), windows, EVENTS_TS)[2]


@register(
    "retain_tables", "stored_requests", "requests",
    oracle=f"""SELECT 'request' AS kind, id FROM stored_requests_v WHERE status = 'queued' OR requested_at >= {NOW} - INTERVAL 7 DAYS
      UNION ALL SELECT 'window', request_id FROM requests_v WHERE ts >= {NOW} - INTERVAL 48 HOURS""",
)
def _retain_tables(spark, d):
    """What is left of both tables, kept by day."""
    root = scratch_path(spark, "retained")
    kept = (
        ("request", "requested_at", "status NOT IN ('queued', 'running')", view(spark, d, "stored_requests"), dt.timedelta(days=7)),
        ("window", "ts", None, view(spark, d, "requests").select(F.col("request_id").alias("id"), "ts"), dt.timedelta(hours=48)),
    )
    out = None
    for kind, ts, closed, rows, age in kept:
        tables.write_days(rows, f"{root}/{kind}", ts, closed)
        tables.retain_days(spark, f"{root}/{kind}", ts, EVENTS_TS - age)
        left = spark.read.parquet(f"{root}/{kind}").select(F.lit(kind).alias("kind"), "id")
        out = left if out is None else out.union(left)
    return out


@register(
    "recover_stale", "source_runs",
    oracle=f"""WITH {REQ_SQL}, stale AS (SELECT req.* FROM req JOIN orders o ON concat('r-', CAST(o.o_orderkey AS VARCHAR)) = req.id WHERE status <> 'success'
        AND o.o_orderdate < TIMESTAMP '2001-06-01' ),
      want AS (SELECT run, unnest(generate_series(1, expected)) AS i FROM stale WHERE expected > 0),
      own AS (SELECT r.* FROM source_runs_v r JOIN stale ON stale.run = r.collection_run_id)
      SELECT run AS collection_run_id, concat('source-', i) AS source_key, 'failed' AS status, 'stale-recovery' AS mode_used FROM want
        WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.collection_run_id = want.run AND own.source_key = concat('source-', i))
      UNION ALL SELECT collection_run_id, source_key, CASE WHEN status = 'running' THEN 'failed' ELSE status END, mode_used FROM own""",
)
def _recover(spark, d):
    runs = view(spark, d, "source_runs")
    sources = spark.range(1, 8).select(
        F.concat(F.lit("source-"), F.col("id").cast("string")).alias("source_key"), F.col("id").cast("int").alias("position"), F.lit(True).alias("enabled")
    )
    cutoff = dt.datetime(2001, 6, 1, 0, 45)
    _, ended = requests.recover_stale(_requests_of_orders(spark, d).drop("matching"), runs, sources, cutoff)
    return ended.select("collection_run_id", "source_key", "status", "mode_used")


@register(
    "recovered_books", "source_runs",
    oracle=f"""WITH {REQ_SQL}, stale AS (SELECT req.* FROM req JOIN orders o ON concat('r-', CAST(o.o_orderkey AS VARCHAR)) = req.id WHERE status <> 'success' AND o.o_orderdate < TIMESTAMP '2001-06-01'),
      want AS (SELECT run, unnest(generate_series(1, expected)) AS i FROM stale WHERE expected > 0),
      own AS (SELECT r.* FROM source_runs_v r JOIN stale ON stale.run = r.collection_run_id),
      e AS (SELECT collection_run_id AS run, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, mode_used, jobs_inserted, items_received,
          CASE WHEN status = 'running' THEN 'STALE_ON_DEMAND_SEARCH' ELSE error_code END AS error_code FROM own
        UNION ALL SELECT run, 'failed', 'stale-recovery', 0, 0, 'STALE_ON_DEMAND_SEARCH' FROM want
          WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.collection_run_id = want.run AND own.source_key = concat('source-', i))),
      b AS (SELECT run, {RUN_STATE} AS run_status, count(*) AS sources_attempted, count(error_code) AS error_count, CAST(sum(items_received) AS BIGINT) AS items_received, CAST(sum(jobs_inserted) AS BIGINT) AS ins,
          count(*) FILTER (status IN ('success', 'partial') OR (status = 'skipped' AND mode_used = 'recent-cache')) AS good,
          count(*) FILTER (status = 'failed' OR (status = 'skipped' AND mode_used <> 'recent-cache')) AS bad FROM e GROUP BY run),
      f AS (SELECT stale.*, b.* EXCLUDE (run), coalesce(good, 0) AS g, coalesce(bad, 0) AS w, coalesce(sources_attempted, 0) AS n FROM stale LEFT JOIN b ON b.run = stale.run)
      SELECT id, CASE WHEN found > 0 THEN CASE WHEN w > 0 OR n <> expected THEN 'partial' ELSE 'success' END WHEN g > 0 THEN 'no_results' ELSE 'failed' END AS status,
        CAST(least(n, expected) AS BIGINT) AS completed_sources, CAST(least(g, expected) AS BIGINT) AS sources_succeeded, coalesce(ins, 0) AS jobs_inserted, found AS matching_jobs,
        coalesce(run_status, 'skipped') AS run_status, sources_attempted, error_count, items_received FROM f""",
)
def _recovered(spark, d):
    sources = spark.range(1, 8).select(
        F.concat(F.lit("source-"), F.col("id").cast("string")).alias("source_key"), F.col("id").cast("int").alias("position"), F.lit(True).alias("enabled")
    )
    rows = _requests_of_orders(spark, d)
    matches = rows.select("id", F.col("matching").alias("matching_jobs"))
    closed, _, statuses, totals = requests.close_stale(rows.drop("matching"), view(spark, d, "source_runs"), sources, matches, dt.datetime(2001, 6, 1, 0, 45))
    books = statuses.withColumnRenamed("status", "run_status").join(totals.select("run_id", "sources_attempted", "error_count", "items_received"), "run_id", "left")
    return closed.join(books, F.col("collection_run_id") == F.col("run_id")).select(
        "id", "status", "completed_sources", "sources_succeeded", "jobs_inserted", "matching_jobs", "run_status", "sources_attempted", "error_count", "items_received"
    )


@register(
    "first_deliveries", "visits",
    oracle="SELECT CAST(visitor_id AS VARCHAR) AS message_id, min((ts, event_id)).event_id AS delivery FROM (SELECT visitor_id, ts, event_id FROM visits_v) GROUP BY 1"
    .replace("min((ts, event_id)).event_id", "arg_min(event_id, (ts, event_id))"),
)
def _first(spark, d):
    rows = view(spark, d, "visits").select(F.col("visitor_id").cast("string").alias("message_id"), "ts", F.col("event_id").alias("delivery"))
    return requests.first_deliveries(rows).select("message_id", "delivery")


# --- visitors --------------------------------------------------------------------------------


@register(
    "visitor_counts", "visits",
    oracle=f"SELECT count(DISTINCT visitor_id) AS total_visitors, count(DISTINCT visitor_id) FILTER (CAST(ts AS DATE) = DATE '{EVENTS_DAY}') AS today_visitors FROM visits_v",
)
def _visitors(spark, d):
    return visitors.visitor_counts(view(spark, d, "visits"), EVENTS_DAY)


@register("visitor_counts_by_day", "visits", oracle="SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS visit_date, count(DISTINCT visitor_id) AS visitors FROM visits_v GROUP BY 1")
def _by_day(spark, d):
    return visitors.visitor_counts_by_day(view(spark, d, "visits"))


@register(
    "visitor_upsert", "visits",
    oracle=f"""WITH dd AS (SELECT sha256(CAST(visitor_id AS VARCHAR)) AS visitor_hash, CAST(ts AS DATE) AS day, min(ts) AS f FROM visits_v GROUP BY 1, 2)
      SELECT visitor_hash, {TS.format('min(f)')} AS first_seen_at, {TS.format('max(f)')} AS last_seen_at FROM dd GROUP BY 1""",
)
def _upsert(spark, d):
    return visitors.visitor_upsert(visitors.visitor_days(view(spark, d, "visits")))
