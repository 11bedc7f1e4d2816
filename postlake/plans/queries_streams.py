"""Streams over the driver's files, run to the end of what is there."""

import datetime as dt

from pyspark.sql import functions as F

from postlake.operators import visitors
from postlake.plans.queries import register, view
from postlake.schemas import sources_table
from postlake.session import cut, scratch_path
from postlake.sources.tables import read_snapshot
from postlake.streaming import runs

NOW = dt.datetime(2001, 6, 1)


def _stream(spark, d, table):
    schema = view(spark, d, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(d)


@register("once_only", oracle="SELECT user_id AS message_id, count(DISTINCT user_id) AS n FROM events GROUP BY user_id")
def _once(spark, d):
    root = scratch_path(spark, "once")
    rows = _stream(spark, d, "events").select(F.col("user_id").alias("message_id"), F.col("ts").cast("timestamp").alias("ts"))
    query = runs.run_batches(
        runs.once_only(rows, "40 days"), lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/checkpoint"
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("message_id").agg(F.count("*").alias("n"))


@register(
    "visitor_stream", "visits",
    oracle="""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS visit_date, sha256(CAST(visitor_id AS VARCHAR)) AS visitor_hash,
      strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen_at FROM visits_v GROUP BY 1, 2""",
)
def _visitors(spark, d):
    root = scratch_path(spark, "visitors")
    visits = _stream(spark, d, "events").select(F.col("user_id").alias("visitor_id"), F.col("ts").cast("timestamp").alias("ts"))
    runs.visitor_stream(visits, f"{root}/days", f"{root}/checkpoint").awaitTermination()
    return runs.read_visitor_days(spark, f"{root}/days")


def _delivered(spark, root, parts, start):
    """Put each of ``parts`` into the inbox and let the stream that ``start`` gives run over it: one micro-batch each."""
    for part in parts:
        part.write.mode("append").parquet(f"{root}/inbox")
        start(spark.readStream.schema(part.schema).parquet(f"{root}/inbox")).awaitTermination()


DAYS = ("2024-01-01", "2024-01-11", "2024-01-21", "2024-03-01")


@register(
    "request_stream", "requests",
    oracle="""WITH RECURSIVE r AS (SELECT query_hash AS q, ts, min(request_id) AS id FROM requests_v GROUP BY ALL),
      c AS (SELECT q, min(ts) AS ts FROM r GROUP BY q UNION ALL SELECT c.q, min(r.ts) FROM c JOIN r ON r.q = c.q AND r.ts > c.ts + INTERVAL 45 MINUTES GROUP BY c.q),
      o AS (SELECT q, ts, id FROM c JOIN r USING (q, ts))
      SELECT request_id, query_hash, CASE WHEN request_id = o.id THEN 'new' ELSE 'active' END AS decision, CASE WHEN request_id <> o.id THEN o.id END AS reuse_id
      FROM requests_v v ASOF JOIN o ON v.query_hash = o.q AND v.ts >= o.ts""",
)
def _requests(spark, d):
    root = scratch_path(spark, "requests")
    rows = view(spark, d, "requests").select("request_id", "query_hash", "ts")
    thirds = [rows.where((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(DAYS, DAYS[1:], strict=False)]
    _delivered(spark, root, thirds, lambda stream: runs.request_stream(stream, f"{root}/kept", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/kept/decisions").select("request_id", "query_hash", "decision", "reuse_id")


HOURS = ("2024-01-01 00:00:00", "2024-01-11 10:31:00", "2024-01-21 17:12:30", "2024-03-01 00:00:00")


@register(
    "rate_stream", "requests",
    oracle="""WITH v AS (SELECT *, row_number() OVER (PARTITION BY visitor_hash, date_trunc('hour', ts) ORDER BY ts, request_id) AS rn FROM requests_v),
      g AS (SELECT request_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, request_id) AS gn FROM v WHERE rn <= 3)
      SELECT request_id, coalesce(gn <= 20, FALSE) AS allowed FROM requests_v LEFT JOIN g USING (request_id)""",
)
def _rates(spark, d):
    root = scratch_path(spark, "rates")
    rows = view(spark, d, "requests").select("request_id", "visitor_hash", "ts")
    thirds = [rows.where((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(HOURS, HOURS[1:], strict=False)]
    _delivered(spark, root, thirds, lambda stream: runs.rate_stream(stream, f"{root}/kept", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/kept/decisions").select("request_id", "allowed")


@register(
    "visitor_ranges", "visits",
    oracle="""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, visitor_id FROM visits_v), r AS (SELECT a.day AS f, b.day AS l FROM (SELECT DISTINCT day FROM d) a JOIN (SELECT DISTINCT day FROM d) b ON a.day <= b.day)
      SELECT CAST(f AS VARCHAR) AS first_day, CAST(l AS VARCHAR) AS last_day, count(DISTINCT visitor_id) AS exact, TRUE AS within_three_errors FROM r JOIN d ON d.day BETWEEN f AND l GROUP BY 1, 2""",
)
def _ranges(spark, d):
    """Any range of days from the sketches that the stream keeps, beside the exact counts."""
    root = scratch_path(spark, "visitors")
    rows = view(spark, d, "visits").select("visitor_id", "ts")
    thirds = [rows.where((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(HOURS, HOURS[1:], strict=False)]
    _delivered(spark, root, thirds, lambda stream: runs.visitor_stream(stream, f"{root}/days", f"{root}/checkpoint"))
    days, sketches = cut(runs.read_visitor_days(spark, f"{root}/days"), "visitor-days"), spark.read.parquet(f"{root}/days-sketches")
    seen = days.select("visit_date").distinct()
    until = seen.agg(F.max("visit_date")).first()[0]
    pairs = seen.select(F.col("visit_date").alias("first_day"), F.explode(F.sequence("visit_date", F.lit(until))).alias("last_day"))
    pairs = pairs.join(seen, F.col("last_day") == F.col("visit_date"), "left_semi")
    both = visitors.exact_range_counts(days, pairs).join(visitors.range_counts(sketches, pairs), ["first_day", "last_day"])
    near = F.abs(F.col("visitors") - F.col("exact")) <= F.ceil(0.049 * F.col("exact"))
    return both.select("first_day", "last_day", "exact", near.alias("within_three_errors"))


FEED = "imechanica-job-channel"


@register(
    "posting_stream",
    oracle=f"""WITH n AS (SELECT *, concat('https://imechanica.org/node/', o_orderkey) AS u, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2000 AS INT) AS dl FROM orders WHERE o_orderstatus = 'O')
      SELECT concat('collected-', substr(sha256(concat('{FEED}', chr(10), u)), 1, 32)) AS id, concat('Postdoc order ', o_orderkey) AS title,
        CAST(dl AS VARCHAR) AS deadline, CASE WHEN dl < DATE '2001-06-01' THEN 'expired' ELSE 'active' END AS collection_state FROM n""",
)
def _postings(spark, d):
    root = scratch_path(spark, "postings")
    entries = _feed(_stream(spark, d, "orders"))
    runs.posting_stream(entries, root, f"{root}/checkpoint", sources_table(spark), lambda: NOW).awaitTermination()
    return read_snapshot(spark, f"{root}/jobs").select("id", "title", "deadline", "collection_state")


def _feed(orders, words=""):
    """Orders as entries of a feed; finished ones as closed entries, pending ones as another kind of post."""
    none, key = F.lit(""), F.col("o_orderkey").cast("string")
    deadline = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 2000).cast("int"))
    return orders.select(
        F.lit(FEED).alias("source_key"),
        F.concat(F.when(F.col("o_orderstatus") == "P", "Lecturer order ").otherwise("Postdoc order "), key, F.lit(words)).alias("title"),
        F.concat(F.lit("<p>Chemistry work. Apply by "), F.date_format(deadline, "d MMMM yyyy"), F.lit(".</p>")).alias("description_html"),
        F.concat(F.lit("https://imechanica.org/node/"), key).alias("link"), key.alias("guid"),
        F.when(F.col("o_orderstatus") == "F", key).alias("source_item_id"),
        F.col("o_orderdate").cast("date").cast("string").alias("pub_date"), F.array(F.lit("Orders")).alias("categories"),
        F.lit("Order Institute").alias("institution"), F.lit("Norway").alias("country"), none.alias("city"), none.alias("deadline"), none.alias("duration"),
        none.alias("employment_type"), F.lit(None).cast("string").alias("apply_url"), F.lit("en").alias("source_language"), F.lit("rss").alias("source_type"),
        (F.col("o_orderstatus") == "F").alias("closed"),
    )


@register(
    "posting_batches",
    oracle=f"""WITH n AS (SELECT *, concat('https://imechanica.org/node/', o_orderkey) AS u, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2000 AS INT) AS dl FROM orders WHERE o_orderstatus = 'O')
      SELECT concat('collected-', substr(sha256(concat('{FEED}', chr(10), u)), 1, 32)) AS id, concat('Postdoc order ', o_orderkey, ' revised') AS title, CAST(dl AS VARCHAR) AS deadline,
        CASE WHEN o_orderpriority = '5-LOW' OR dl < DATE '2001-06-01' THEN 'expired' ELSE 'active' END AS collection_state, o_orderpriority <> '5-LOW' AS is_active, 1 AS observations FROM n""",
)
def _batches(spark, d):
    """Three micro-batches: postings, the same with new titles, and these again while some are closed."""
    root = scratch_path(spark, "postings")
    orders = view(spark, d, "orders")
    low = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "O")
    revised = _feed(orders, " revised")
    ended = _feed(orders.where(low)).withColumns({"source_item_id": F.col("link"), "closed": F.lit(True)})
    parts = [_feed(orders), revised, _feed(orders.where(~low), " revised").unionByName(ended)]
    _delivered(spark, root, parts, lambda stream: runs.posting_stream(stream, f"{root}/kept", f"{root}/checkpoint", sources_table(spark), lambda: NOW))
    jobs = read_snapshot(spark, f"{root}/kept/jobs")
    seen = read_snapshot(spark, f"{root}/kept/observations").groupBy("job_id").agg(F.count("*").alias("observations"))
    return jobs.join(seen, F.col("id") == F.col("job_id")).select("id", "title", "deadline", "collection_state", "is_active", "observations")
