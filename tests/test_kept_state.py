"""State kept between batches: rate windows, visitor sketches, tables by day."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from postlake.operators.requests import add_counts, rate_counts, rate_limit
from postlake.operators.visitors import day_sketches, exact_range_counts, range_counts, visitor_days
from postlake.sources.tables import read_snapshot, retain_days, write_days
from postlake.streaming import runs

T0 = dt.datetime(2026, 8, 2, 12)
FORM = "request_id string, visitor_hash string, ts timestamp"


def some_requests(n=240):
    rnd = random.Random(7)
    return [(f"{k:04d}", rnd.choice(["hot", "hot", "b", "c", "d"]), T0 + dt.timedelta(seconds=rnd.randrange(4 * 3600))) for k in range(n)]


def test_rate_limit_in_parts_equals_one_by_one(spark):
    rows = sorted(some_requests(), key=lambda r: (r[2], r[0]))
    used, total, want = {}, {}, {}
    for rid, visitor, ts in rows:
        hour = ts.replace(minute=0, second=0)
        want[rid] = used.get((visitor, hour), 0) < 4 and total.get(hour, 0) < 9
        if want[rid]:
            used[visitor, hour] = used.get((visitor, hour), 0) + 1
            total[hour] = total.get(hour, 0) + 1
    kept = spark.createDataFrame([], "scope_type string, scope_key string, window_start timestamp, request_count long")
    got = {}
    for part in (rows[:50], rows[50:51], rows[51:170], rows[170:]):
        limited = rate_limit(spark.createDataFrame(part, FORM), 4, 9, used=kept)
        got |= {r.request_id: r.allowed for r in limited.collect()}
        kept = spark.createDataFrame(add_counts(kept, rate_counts(limited)).collect(), kept.schema)
    assert got == want
    assert {(r.scope_key, r.window_start): r.request_count for r in kept.where("scope_type = 'visitor'").collect()} == used


def test_late_requests_are_set_aside(spark, tmp_path):
    inbox, root = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [("a", "v", T0), ("b", "v", T0 + dt.timedelta(hours=5))],
        [("late", "v", T0 + dt.timedelta(hours=1)), ("c", "v", T0 + dt.timedelta(hours=4)), ("d", "v", T0 + dt.timedelta(hours=5, minutes=1))],
    ]
    for batch in batches:
        spark.createDataFrame(batch, FORM).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(FORM).parquet(inbox)
        runs.rate_stream(stream, root, str(tmp_path / "check"), per_visitor=1).awaitTermination()
    decided = {r.request_id: r.allowed for r in spark.read.parquet(f"{root}/decisions").collect()}
    assert decided == {"a": True, "b": True, "c": True, "d": False}
    assert [r.request_id for r in spark.read.parquet(f"{root}/late").collect()] == ["late"]
    kept = read_snapshot(spark, f"{root}/used")
    assert kept.where(F.col("window_start") < T0 + dt.timedelta(hours=3)).isEmpty() and not kept.isEmpty()


def test_sketches_of_any_range(spark):
    rnd = random.Random(2)
    visits = spark.createDataFrame([(rnd.randrange(9_000), T0 + dt.timedelta(hours=rnd.randrange(240))) for _ in range(40_000)], "visitor_id long, ts timestamp")
    days = visitor_days(visits).cache()
    half = F.hash("visitor_hash") % 2 == 0
    sketches = day_sketches(days.where(half)).union(day_sketches(days.where(~half)))
    ranges = spark.createDataFrame([(T0.date() + dt.timedelta(days=a), T0.date() + dt.timedelta(days=b)) for a in range(11) for b in (a, a + 2, a + 30)] + [(dt.date(2020, 1, 1), dt.date(2020, 1, 2))], "first_day date, last_day date")
    about = {(r.first_day, r.last_day): r.visitors for r in range_counts(sketches, ranges).collect()}
    exact = {(r.first_day, r.last_day): r.exact for r in exact_range_counts(days, ranges).collect()}
    assert about.keys() == exact.keys() and max(exact.values()) > 8_000 and exact[dt.date(2020, 1, 1), dt.date(2020, 1, 2)] == 0
    assert all(abs(about[k] - n) <= 0.05 * n for k, n in exact.items())


def files(root):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(root) for f in names if f.startswith("part-")}


def test_retention_touches_no_kept_day(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = [(f"{d}-{h}", T0 + dt.timedelta(days=-d, hours=h - 12), "queued" if (d + h) % 5 == 0 else "success") for d in range(12) for h in range(0, 24, 3)]
    write_days(spark.createDataFrame(rows, "id string, at timestamp, status string"), root, "at", "status <> 'queued'")
    before = files(root)
    until = T0 - dt.timedelta(days=7)
    done = retain_days(spark, root, "at", until)
    assert done["rewritten"] == [until.date().isoformat()] and len(done["dropped"]) == 4
    want = {i for i, at, status in rows if status == "queued" or at >= until}
    assert {r.id for r in spark.read.parquet(root).select("id").collect()} == want
    after = files(root)
    kept = {f: t for f, t in before.items() if "closed=false" in f or f.split("day=")[1][:10] > until.date().isoformat()}
    assert kept.items() <= after.items()
    again = retain_days(spark, root, "at", until)
    assert again["dropped"] == [] and {r.id for r in spark.read.parquet(root).select("id").collect()} == want
    assert retain_days(spark, str(tmp_path / "none"), "at", until) == {"dropped": [], "rewritten": []}


def test_ranges_count_visitors_without_a_row_for_each_range(spark):
    """Exact counts by range: days between, days before and no days at all; work follows the visitor days."""
    from postlake.operators.visitors import exact_range_counts

    d = lambda n: dt.date(2024, 1, n)
    days = [("a", 1), ("a", 3), ("a", 3), ("b", 2), ("c", 5), ("c", 1), (None, 4)]
    rows = spark.createDataFrame([(v, d(n)) for v, n in days], "visitor_hash string, visit_date date")
    ranges = spark.createDataFrame([(d(f), d(t)) for f in range(1, 8) for t in range(f, 8)] + [(d(1), d(7))], "first_day date, last_day date")
    got = {(r.first_day.day, r.last_day.day): r.exact for r in exact_range_counts(rows, ranges).collect()}
    assert got == {(f, t): len({v for v, n in days if v and f <= n <= t}) for f in range(1, 8) for t in range(f, 8)}
    # Rows that leave a shuffle follow the days of visitors, not the ranges.
    text = exact_range_counts(rows, ranges)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in text
