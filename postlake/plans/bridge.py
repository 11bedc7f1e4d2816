"""The driver's tables seen as postings, observations, requests, runs and documents.

Each view is one SQL text that both engines accept, so a query and its oracle start from the
same rows. ``{name}`` stands for a table: a DataFrame here, a view there.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from postlake.sources.tables import _fs

AS_OF = dt.date(2001, 6, 1)
AS_OF_TS = dt.datetime(2001, 6, 1)
EVENTS_DAY = dt.date(2024, 1, 15)
EVENTS_TS = dt.datetime(2024, 1, 30)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_KEY = "lpad(CAST(o_orderkey AS STRING), 12, '0')"

VIEWS: dict[str, str] = {
    # One posting per order.
    "postings": f"""
        SELECT {_KEY} AS id,
               concat(c_mktsegment, ' ', o_orderpriority, ' ', CAST(o_orderkey % 1000 AS STRING)) AS title,
               c_name AS institution, n_name AS country,
               concat('City ', CAST(c_custkey % 50 AS STRING)) AS city,
               c_mktsegment AS research_area,
               CASE n_regionkey WHEN 0 THEN 'English' WHEN 1 THEN 'German'
                    WHEN 2 THEN 'English/French' ELSE 'Spanish' END AS language,
               CASE n_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS source_language,
               concat(c_mktsegment, ' ', o_orderpriority, ' ', CAST(o_orderkey % 1000 AS STRING)) AS original_title,
               concat('Order of ', c_name, ' in ', n_name) AS original_description,
               concat('Order of ', c_name, ' in ', n_name) AS description,
               CASE WHEN o_orderkey % 4 = 0 THEN concat('https://jobs.example.org/postings/', {_KEY})
                    ELSE concat('https://careers.example.org/jobs/', {_KEY}) END AS apply_url,
               concat('https://jobs.example.org/postings/', {_KEY}) AS source_url,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL
                    ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2000 AS INT) END AS deadline,
               CAST(o_orderdate AS DATE) AS posted_at,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Full-time' END AS employment_type,
               CASE o_orderkey % 3 WHEN 0 THEN '2 years' WHEN 1 THEN '18 months' ELSE NULL END AS duration,
               split(concat(lower(c_mktsegment), ',', lower(o_orderstatus)), ',') AS tags,
               o_orderstatus <> 'F' AS is_active,
               o_orderstatus = 'P' AS is_demo,
               CAST(o_orderdate AS TIMESTAMP) AS created_at,
               CAST(o_orderdate AS TIMESTAMP) AS updated_at,
               CASE WHEN o_orderstatus = 'P' THEN 'seed' ELSE 'collected' END AS origin_type,
               o_orderpriority AS source_key,
               concat('Source ', o_orderpriority) AS source_name,
               concat('item-', CAST(o_orderkey AS STRING)) AS source_item_id,
               CAST(NULL AS STRING) AS content_hash,
               CAST(o_orderdate AS TIMESTAMP) AS first_seen_at,
               CAST(o_orderdate AS TIMESTAMP) AS last_seen_at,
               CAST(o_orderdate AS TIMESTAMP) AS last_verified_at,
               CASE WHEN o_orderstatus = 'F' THEN 'expired' WHEN o_orderkey % 7 = 0 THEN 'stale' ELSE 'active' END AS collection_state,
               CASE WHEN o_orderkey % 8 >= 4 THEN 'html' ELSE 'rss' END AS source_type,
               concat('https://jobs.example.org/postings/', {_KEY}) AS canonical_url,
               CASE WHEN o_orderstatus = 'F' THEN 'past_deadline' ELSE NULL END AS expiry_reason,
               o_orderkey
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
        JOIN {{nation}} ON c_nationkey = n_nationkey""",
    # The five sources those postings name.
    "source_dim": """
        SELECT source_key, concat('Registered ', source_key) AS name, priority, priority <= 20 AS institution_owned
        FROM (VALUES ('1-URGENT', 10), ('2-HIGH', 20), ('3-MEDIUM', 30), ('4-NOT SPECIFIED', 40), ('5-LOW', 50), ('mirror', 25))
             AS s(source_key, priority)""",
    # One observation per order line.
    "observations": """
        SELECT lpad(CAST(l_orderkey AS STRING), 12, '0') AS job_id,
               concat('supplier-', CAST(l_suppkey AS STRING)) AS source_key,
               concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS source_item_id,
               CASE WHEN l_linestatus = 'O' THEN 'active' ELSE 'expired' END AS observation_state,
               CAST(l_shipdate AS TIMESTAMP) AS first_seen_at,
               l_linenumber, l_suppkey, l_quantity, l_returnflag
        FROM {lineitem}""",
    # A second delivery of every posting: as it was, changed, by another source, or a new posting twice.
    "incoming": """
        SELECT o_orderkey * 2 + copy AS batch_seq, o_orderkey, o_orderkey % 4 AS change,
               concat(CASE o_orderkey % 4 WHEN 2 THEN 'mirror-' WHEN 3 THEN 'new-' ELSE 'again-' END, id) AS id,
               CASE o_orderkey % 4 WHEN 1 THEN concat(title, ' (changed)') WHEN 3 THEN concat('New ', title) ELSE title END AS title,
               institution, country, city, research_area, language, source_language,
               CASE o_orderkey % 4 WHEN 1 THEN concat(title, ' (changed)') WHEN 3 THEN concat('New ', title) ELSE title END AS original_title,
               original_description, description,
               CASE o_orderkey % 4 WHEN 3 THEN concat('https://careers.example.org/new/', id) ELSE apply_url END AS apply_url,
               CASE o_orderkey % 4 WHEN 2 THEN concat('https://mirror.example.org/', id) WHEN 3 THEN concat('https://jobs.example.org/new/', id) ELSE source_url END AS source_url,
               CASE o_orderkey % 4 WHEN 1 THEN deadline + 10 ELSE deadline END AS deadline,
               posted_at, employment_type, duration, tags, TRUE AS is_active, FALSE AS is_demo,
               TIMESTAMP '2001-06-01 00:00:00' AS created_at, TIMESTAMP '2001-06-01 00:00:00' AS updated_at,
               'collected' AS origin_type,
               CASE o_orderkey % 4 WHEN 2 THEN 'mirror' ELSE source_key END AS source_key,
               CASE o_orderkey % 4 WHEN 2 THEN 'Mirror' ELSE source_name END AS source_name,
               concat(CASE o_orderkey % 4 WHEN 2 THEN 'm-' WHEN 3 THEN 'new-' ELSE 'item-' END, CAST(o_orderkey AS STRING)) AS source_item_id,
               CAST(NULL AS STRING) AS content_hash,
               TIMESTAMP '2001-06-01 00:00:00' AS first_seen_at, TIMESTAMP '2001-06-01 00:00:00' AS last_seen_at,
               TIMESTAMP '2001-06-01 00:00:00' AS last_verified_at,
               'active' AS collection_state,
               CASE o_orderkey % 4 WHEN 1 THEN 'rss' ELSE source_type END AS source_type,
               CASE o_orderkey % 4 WHEN 2 THEN concat('https://mirror.example.org/', id) WHEN 3 THEN concat('https://jobs.example.org/new/', id) ELSE canonical_url END AS canonical_url,
               CAST(NULL AS STRING) AS expiry_reason
        FROM (SELECT *, 0 AS copy FROM {postings} UNION ALL SELECT *, 1 AS copy FROM {postings} WHERE o_orderkey % 4 = 3) t""",
    # Observations known before that delivery: every posting's own, and some by the mirror.
    "known": """
        SELECT id AS job_id, source_key, source_item_id, TRUE AS is_primary, first_seen_at FROM {postings}
        WHERE origin_type = 'collected'
        UNION ALL
        SELECT id AS job_id, 'mirror' AS source_key, concat('m-', CAST(o_orderkey AS STRING)) AS source_item_id,
               FALSE AS is_primary, first_seen_at
        FROM {postings} WHERE origin_type = 'collected' AND o_orderkey % 8 = 2""",
    # Deliveries of one feed item per order, one per order line.
    "deliveries": """
        SELECT (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000) * 100 + CAST(l_quantity AS INT) AS batch_seq,
               concat('item-', CAST(l_orderkey AS STRING)) AS source_item_id,
               concat('Postdoc line ', l_returnflag) AS title, l_linestatus AS city, l_orderkey
        FROM {lineitem}""",
    # Requests and visits.
    "visits": "SELECT event_id, user_id AS visitor_id, CAST(ts AS TIMESTAMP) AS ts FROM {events}",
    "requests": """
        SELECT CAST(event_id AS STRING) AS request_id, CAST(user_id AS STRING) AS visitor_hash,
               CAST(ts AS TIMESTAMP) AS ts, event_type AS keyword,
               concat('Area ', CAST(CAST(floor(value / 20) AS INT) AS STRING)) AS country,
               concat(event_type, '/', CAST(CAST(floor(value / 20) AS INT) AS STRING)) AS query_hash,
               value
        FROM {events}""",
    # What each event would search for: keywords of several lengths, some that nothing holds, and all filters.
    "searches": """
        SELECT CAST(event_id AS STRING) AS request_id,
               CASE user_id % 8 WHEN 0 THEN concat(' NATION_', CAST(user_id % 25 AS STRING)) WHEN 1 THEN 'Urgent' WHEN 2 THEN CAST(user_id % 100 AS STRING)
                    WHEN 3 THEN '","' WHEN 4 THEN concat('no such ', event_type) WHEN 5 THEN 'o' ELSE '' END AS keyword,
               CASE WHEN event_type IN ('view', 'error') THEN concat('Nation_', CAST(user_id % 25 AS STRING), ' ') ELSE '' END AS country,
               CASE WHEN event_type = 'click' THEN 'BUILDING' WHEN event_type = 'error' THEN 'machinery' ELSE '' END AS research_area,
               CASE CAST(floor(value) AS INT) % 3 WHEN 0 THEN 'ENGL' WHEN 1 THEN 'french' ELSE '' END AS language,
               CASE CAST(floor(value) AS INT) % 7 WHEN 0 THEN '7' WHEN 1 THEN '30' WHEN 2 THEN '60' WHEN 3 THEN 'open' WHEN 4 THEN 'none' ELSE 'other' END AS deadline
        FROM {events}""",
    # Stored requests: the purchases, with a life of their own.
    "stored_requests": """
        SELECT concat('stored-', CAST(event_id AS STRING)) AS id,
               concat('view', '/', CAST(CAST(floor(value / 20) AS INT) AS STRING)) AS query_hash,
               CASE CAST(floor(value) AS INT) % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'success' WHEN 2 THEN 'no_results' ELSE 'failed' END AS status,
               CAST(ts AS TIMESTAMP) AS requested_at,
               CAST(ts AS TIMESTAMP) + INTERVAL 12 HOURS AS cache_expires_at
        FROM {events} WHERE event_type = 'purchase'""",
    # Source runs: one per order and line number.
    "source_runs": """
        SELECT CAST(l_orderkey AS STRING) AS collection_run_id,
               concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS message_id,
               concat('source-', CAST(l_linenumber AS STRING)) AS source_key,
               CASE WHEN sum(l_quantity) > 95 THEN 'running'
                    WHEN max(l_returnflag) = 'R' AND max(l_linestatus) = 'F' THEN 'failed'
                    WHEN max(l_returnflag) = 'A' AND max(l_linestatus) = 'F' THEN 'skipped'
                    WHEN max(l_returnflag) = 'A' THEN 'partial'
                    ELSE 'success' END AS status,
               CASE WHEN l_linenumber % 2 = 0 THEN 'recent-cache' ELSE 'rss' END AS mode_used,
               CAST(sum(l_quantity) AS BIGINT) AS items_received,
               CAST(min(l_quantity) AS BIGINT) AS items_accepted,
               CAST(count(*) AS BIGINT) AS items_rejected,
               CAST(max(l_partkey) % 5 AS BIGINT) AS jobs_inserted,
               CAST(max(l_partkey) % 7 AS BIGINT) AS jobs_updated,
               CAST(max(l_suppkey) % 3 AS BIGINT) AS jobs_unchanged,
               CAST(max(l_suppkey) % 2 AS BIGINT) AS jobs_expired,
               CASE WHEN max(l_returnflag) = 'R' THEN 'SOURCE_TIMEOUT' ELSE NULL END AS error_code
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    # Collection attempts by source.
    "history": """
        SELECT concat('source-', CAST(user_id AS STRING)) AS source_key, CAST(ts AS TIMESTAMP) AS ts, event_id AS attempt_id,
               event_type IN ('view', 'purchase') AS ok,
               CASE WHEN value > 20 THEN props ELSE NULL END AS etag,
               CASE WHEN value < 1 THEN 'ROBOTS_DISALLOWED' WHEN value < 20 THEN 'SOURCE_TOO_LARGE' ELSE 'SOURCE_TIMEOUT' END AS code,
               CASE WHEN value > 60 THEN TRUE ELSE NULL END AS retryable,
               CAST(floor(value) AS INT) % 6 AS attempts,
               CASE WHEN event_type = 'error' THEN 'Invalid configuration' ELSE 'Timed out' END AS message
        FROM {events}""",
    # One preference profile per customer; what it is shown are its own orders.
    "profiles": """
        SELECT CAST(c_custkey AS STRING) AS profile_id,
               concat(c_mktsegment, ' order x') AS research_keywords,
               CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(n_name, '; NATION_1') END AS countries,
               CASE WHEN c_custkey % 2 = 0 THEN 'English, de' ELSE '' END AS source_languages,
               CASE c_custkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN '30' WHEN 2 THEN '60' ELSE '' END AS deadline,
               CASE WHEN c_custkey % 5 = 0 THEN '24' ELSE '' END AS minimum_duration_months,
               c_custkey % 2 = 1 AS require_direct_application,
               c_custkey % 3 = 1 AS prefer_official_source
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "shown": "SELECT CAST(o_custkey AS STRING) AS profile_id, lpad(CAST(o_orderkey AS STRING), 12, '0') AS id FROM {orders}",
    # Adds to a comparison: every order line of a customer, in order of lines.
    "selection_events": """
        SELECT CAST(o_custkey AS STRING) AS profile_id,
               (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000) * 100 + CAST(l_quantity AS INT) AS seq,
               CASE WHEN l_partkey % 50 = 0 THEN ' ' ELSE lpad(CAST(l_partkey % 40 AS STRING), 12, '0') END AS job_id
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # Documents as entries: the first line is the title.
    "entries": """
        SELECT doc_id, source AS source_key, lang, split(text, '\n')[{first}] AS title, text AS description_html
        FROM {documents}""",
}

#: Views that read other views.
_DEPENDS = {"incoming": ("postings",), "known": ("postings",)}


#: Bytes from which on a table's files make a task for each core by themselves.
_SPLIT = 64 << 20
#: Tables whose rows cost much more to work on than to read.
COSTLY = ("orders", "documents", "pages")


def _table(spark: SparkSession, path: str, spread: bool) -> DataFrame:
    """A table; with ``spread`` one that makes fewer tasks than there are cores is dealt to all of them.

    A file of a few megabytes is one row group and so one task, whatever is then done to its rows.
    Tables of many files are read as they are.
    """
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread:
        files, at = _fs(spark, path)
        if files.getContentSummary(at(path)).getLength() < cores * _SPLIT:
            return rows.repartition(cores)
    return rows


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table or a view of it as a DataFrame."""
    if name in TABLES:
        return _table(spark, f"{sf_dir}/{name}.parquet", spread and name in COSTLY)
    text = VIEWS[name]
    used = [t for t in (*TABLES, *VIEWS) if "{" + t + "}" in text]
    frames = {t: view(spark, sf_dir, t, spread) for t in used}
    return spark.sql(text.replace("{first}", "0"), **frames)


def with_views(sql: str, *names: str) -> str:
    """Oracle text: the views named, and what they need, in front of ``sql``."""
    need: list[str] = []

    def add(name: str) -> None:
        for inner in _DEPENDS.get(name, ()):
            add(inner)
        if name not in need:
            need.append(name)

    for name in names:
        add(name)
    ctes = ", ".join(
        f"{n}_v AS ({VIEWS[n].replace('{first}', '1').format_map({t: t for t in TABLES} | {v: v + '_v' for v in VIEWS})})"
        for n in need
    )
    text = sql.strip()
    if not need:
        return text
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {ctes}, {text[5:]}"
    return f"WITH {ctes} {text}"
