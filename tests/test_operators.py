"""Requests, search, scoring, accounting on small inputs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from postlake.operators.accounting import request_status, run_status
from postlake.operators.requests import answer_requests, rate_limit, recover_stale, usable, validate_requests
from postlake.operators.score import duration_months, score_for_profile
from postlake.operators.search import normalize_filters, public_dataset, search_page, search_total
from postlake.operators.selection import clear_positions, remove_positions, select_positions
from postlake.sources.tables import read_snapshot, sample_postings, seed_load, snapshots, write_snapshot
from postlake.schemas import JOB, REQUEST, SOURCE_RUN

T0 = dt.datetime(2026, 8, 2, 12)


def test_rate_limit_equals_one_by_one(spark):
    rnd = random.Random(1)
    rows = [(f"{i:04d}", rnd.choice(["hot", "hot", "b", "c", "d"]), T0 + dt.timedelta(minutes=rnd.randrange(180))) for i in range(200)]
    used, total, want = {}, {}, {}
    for rid, visitor, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        hour = ts.replace(minute=0)
        ok = used.get((visitor, hour), 0) < 3 and total.get(hour, 0) < 8
        if ok:
            used[visitor, hour] = used.get((visitor, hour), 0) + 1
            total[hour] = total.get(hour, 0) + 1
        want[rid] = ok
    df = spark.createDataFrame(rows, "request_id string, visitor_hash string, ts timestamp")
    assert {r.request_id: r.allowed for r in rate_limit(df, 3, 8).collect()} == want


def test_answers_equal_one_by_one(spark):
    rnd = random.Random(2)
    rows = [(f"{i:03d}", rnd.choice("ab"), T0 + dt.timedelta(minutes=2 * i)) for i in range(60)]
    stored = [("s1", "a", "success", T0 - dt.timedelta(hours=11), T0 + dt.timedelta(minutes=25)), ("s2", "b", "queued", T0 - dt.timedelta(minutes=30), T0)]
    last, want = {"a": None, "b": ("s2", T0 - dt.timedelta(minutes=30))}, {}
    for rid, q, ts in rows:
        if last[q] and last[q][1] >= ts - dt.timedelta(minutes=45):
            want[rid] = ("active", last[q][0])
        elif q == "a" and ts < T0 + dt.timedelta(minutes=25):
            want[rid] = ("cached", "s1")
        else:
            last[q] = (rid, ts)
            want[rid] = ("new", None)
    df = spark.createDataFrame(rows, "request_id string, query_hash string, ts timestamp")
    st = spark.createDataFrame(stored, "id string, query_hash string, status string, requested_at timestamp, cache_expires_at timestamp")
    decisions, claims = answer_requests(df, st)
    assert {r.request_id: (r.decision, r.reuse_id) for r in decisions.collect()} == want
    assert {r.id for r in claims.collect()} == {k for k, v in want.items() if v[0] == "new"}


def test_answers_of_one_hot_query(spark):
    rnd = random.Random(3)
    rows = [(f"{i:05d}", "hot", T0 + dt.timedelta(seconds=rnd.randrange(40 * 86_400 // 60) * 60)) for i in range(3_000)]
    rows += [(f"x{i:02d}", "same", T0) for i in range(40)]
    last, want = {}, {}
    for rid, q, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if q in last and last[q][1] >= ts - dt.timedelta(minutes=45):
            want[rid] = ("active", last[q][0])
        else:
            last[q], want[rid] = (rid, ts), ("new", None)
    df = spark.createDataFrame(rows, "request_id string, query_hash string, ts timestamp").repartition(5)
    none = spark.createDataFrame([], "id string, query_hash string, status string, requested_at timestamp, cache_expires_at timestamp")
    decisions, _ = answer_requests(df, none)
    assert {r.request_id: (r.decision, r.reuse_id) for r in decisions.collect()} == want
    assert sum(v[0] == "new" for v in want.values()) > 500


def test_what_cannot_answer_any_more_is_dropped(spark):
    stored = [("a", "q", "queued", T0, None), ("b", "q", "queued", T0 - dt.timedelta(minutes=46), None), ("c", "q", "success", T0, T0), ("d", "q", "partial", T0, T0 + dt.timedelta(seconds=1)), ("e", "q", "failed", T0, None)]
    st = spark.createDataFrame(stored, "id string, query_hash string, status string, requested_at timestamp, cache_expires_at timestamp")
    assert sorted(r.id for r in usable(st, T0).collect()) == ["a", "d"]


def test_validate_requests(spark):
    cases = {
        '{"keyword":"physics"}': None, '{"keyword":7}': "INVALID_REQUEST", '{"other":"x"}': "INVALID_REQUEST", "[1]": "INVALID_REQUEST", "oops": "INVALID_REQUEST",
        '{"keyword":"' + "x" * 151 + '"}': "VALUE_TOO_LONG", '{"country":"<b>"}': "UNSAFE_FILTER", '{"deadline":"soon","keyword":"a"}': "INVALID_DEADLINE",
        '{"keyword":" "}': "EMPTY_FILTER", '{"deadline":"30"}': None, "{}": "EMPTY_FILTER",
    }
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(cases)], "request_id string, payload string")
    got = {int(r.request_id): r.error_code for r in validate_requests(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def page_set(spark):
    columns = [c.split()[0] for c in JOB.replace("\n", " ").split(",")]
    values = dict(title="Postdoc", institution="I", language="English", description="d", apply_url="https://a.org/1", posted_at=T0.date(), created_at=T0,
                  tags=["t"], is_active=True, is_demo=False, origin_type="collected", source_key="s", collection_state="active")
    rows = [
        tuple({**values, "id": f"fixture-{i:03d}", "country": "Canada" if i % 3 == 0 else "Norway", "research_area": "Physics" if i % 2 else "Chemistry"}.get(c) for c in columns)
        for i in range(1, 66)
    ]
    return spark.createDataFrame(rows, JOB)


def test_pages_part_the_result(spark):
    jobs, day = page_set(spark), T0.date()
    pages = [[r.id for r in search_page(jobs, {}, day, 20, o).collect()] for o in (0, 20, 40, 60, 80)]
    assert [len(p) for p in pages] == [20, 20, 20, 5, 0]
    assert (pages[0][0], pages[0][-1], pages[1][0]) == ("fixture-065", "fixture-046", "fixture-045")
    assert len({i for p in pages for i in p}) == 65
    total = search_total(jobs, {"country": "canada", "research_area": " physics"}, day, 5).first()
    assert (total.total, total.shown, total.has_more) == (11, 5, True)
    demo = jobs.withColumns({"is_demo": F.lit(True), "origin_type": F.lit("seed"), "id": F.concat(F.lit("d-"), "id")})
    assert public_dataset(jobs.unionByName(demo), day).where("is_demo").isEmpty()
    assert public_dataset(jobs.where("false").unionByName(demo), day).count() == 65
    assert normalize_filters({"q": " x ", "deadline": "Soon"}) == dict(keyword="x", country="", research_area="", language="", deadline="any")


def test_scores(spark):
    job = spark.createDataFrame(
        [("j", "Postdoc in Quantum Physics", "Physics", "Work on café optics", "Canada", "Toronto", "en", dt.date(2026, 8, 20), "https://a.org/apply", "https://b.org/x", True, "24 months", "Full-time", ["AI"])],
        "id string, title string, research_area string, description string, country string, city string, source_language string, deadline date, apply_url string, source_url string, official_source boolean, duration string, employment_type string, tags array<string>",
    )
    profile = dict(profile_id="p", research_keywords="quantum robotics optics", countries="Canada; Norway", source_languages="English", deadline="30",
                   minimum_duration_months="12", require_direct_application=True, prefer_official_source=True)
    r = score_for_profile(job, profile, T0.date()).first()
    assert [c.points for c in r.criteria] == [27, 12, 8, 15, 8, 7, 10] and r.score == 87
    assert r.reasons[0] == "Research terms matched: quantum, optics (+27)"
    assert score_for_profile(job, {"profile_id": "p"}, T0.date()).isEmpty()
    months = spark.createDataFrame([("1.5 years",), ("18 months",), ("soon",)], "d string").select(duration_months(F.col("d")).alias("m"))
    assert [x.m for x in months.collect()] == [60, 18, None]


def test_selection(spark):
    events = spark.createDataFrame([("p", i, j) for i, j in enumerate(["a", "b", "a", " ", "c", "d", "b", "d"])], "profile_id string, seq long, job_id string")
    got = [r.status for r in select_positions(events).orderBy("seq").collect()]
    assert got == ["added", "added", "duplicate", "invalid", "added", "limit", "duplicate", "limit"]
    chosen = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "profile_id string, job_id string")
    assert remove_positions(chosen, spark.createDataFrame([("p", " a")], "profile_id string, job_id string")).count() == 2
    assert clear_positions(chosen, spark.createDataFrame([("p",)], "profile_id string")).count() == 1


def test_runs_and_requests(spark, sources):
    cols = [c.split()[0] for c in SOURCE_RUN.replace("\n", " ").split(",")]
    runs = [("r1", "success", "rss"), ("r1", "partial", "rss"), ("r2", "running", "rss"), ("r3", "skipped", "recent-cache"), ("r3", "skipped", "backoff"), ("r4", "failed", "rss"), ("r5", "success", "rss")]
    rows = [tuple({"collection_run_id": r, "message_id": str(i), "source_key": f"s{i}", "status": s, "mode_used": m, "jobs_inserted": 1}.get(c) for c in cols) for i, (r, s, m) in enumerate(runs)]
    df = spark.createDataFrame(rows, SOURCE_RUN)
    ids = spark.createDataFrame([(f"r{i}",) for i in range(1, 7)], "run_id string")
    assert {r.run_id: r.status for r in run_status(ids, df).collect()} == {"r1": "partial", "r2": "running", "r3": "skipped", "r4": "failed", "r5": "success", "r6": "skipped"}
    rcols = [c.split()[0] for c in REQUEST.replace("\n", " ").split(",")]
    make = lambda i, n: {"id": f"q{i}", "collection_run_id": f"r{i}", "status": "queued", "requested_at": T0 - dt.timedelta(hours=2), "expected_sources": n}
    reqs = spark.createDataFrame([tuple(make(i, n).get(c) for c in rcols) for i, n in ((1, 2), (2, 1), (3, 2), (4, 1), (5, 1), (6, 2))], REQUEST)
    matches = spark.createDataFrame([("q1", 3), ("q5", 1)], "id string, matching_jobs long")
    got = {r.id: (r.status, r.completed_sources, r.sources_succeeded) for r in request_status(reqs, df, matches, T0).collect()}
    assert got == {"q1": ("success", 2, 2), "q2": ("running", 0, 0), "q3": ("no_results", 2, 1), "q4": ("failed", 1, 0), "q5": ("success", 1, 1), "q6": ("running", 0, 0)}
    stale, ended = recover_stale(reqs.where("id in ('q2', 'q6')"), df, sources, T0)
    assert stale.count() == 2
    assert sorted((r.collection_run_id, r.status) for r in ended.collect()) == [("r2", "failed"), ("r2", "failed"), ("r6", "failed"), ("r6", "failed")]


def test_tables(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.range(3)
    write_snapshot(df, root)
    write_snapshot(df.where("id > 0"), root)
    (tmp_path / "t" / "snapshot=9").mkdir()
    assert snapshots(spark, root) == [1, 2]
    assert read_snapshot(spark, root).count() == 2 and read_snapshot(spark, root, number=1).count() == 3
    empty = spark.createDataFrame([], JOB)
    rows = spark.createDataFrame([("d1", 1, "Old", 5, -1), ("d1", 2, "New", 9, -2)], "id string, load_no int, title string, deadline_offset int, posted_offset int")
    got = seed_load(empty, rows, T0.date()).collect()
    assert [(r.title, r.deadline, r.is_demo) for r in got] == [("New", dt.date(2026, 8, 11), True)]
    sample = sample_postings(spark.createDataFrame([(7, None, -3, "T")], "template_no int, deadline_offset int, posted_offset int, title string"), T0.date()).first()
    assert (sample.id, sample.deadline, sample.posted_at, sample.created_at) == ("job-007", None, dt.date(2026, 7, 30), dt.datetime(2026, 7, 30, 10))


def test_rows_that_repeat_an_identity_look_for_no_other_key(spark, monkeypatch):
    """A repeat follows the first row of its identity; only first rows and rows without one search further."""
    from postlake import schemas
    from postlake.operators import match

    columns = [c.split()[0] for c in schemas.JOB.replace("\n", " ").split(",")]
    base = spark.createDataFrame([], "batch_seq long, explicit boolean, " + schemas.JOB)
    given = [(1, "a", "x1", "t"), (2, "a", "x1", "u"), (3, "a", "x1", "t"), (4, "b", "y2", "T"), (5, None, None, "u"), (6, None, None, "z")]
    small = spark.createDataFrame(given, "batch_seq long, source_key string, source_item_id string, title string").withColumns(
        {"institution": F.lit("I"), "deadline": F.lit("2026-01-01").cast("date"), "explicit": F.lit(False)}
    )
    rows = small.select("batch_seq", "explicit", *[
        (F.col(c) if c in small.columns else F.lit(None)).cast(base.schema[c].dataType).alias(c) for c in columns
    ])
    asked = []
    wanted = match.wanted_keys
    monkeypatch.setattr(match, "wanted_keys", lambda rows, *steps: asked.append(sorted(r[0] for r in rows.select("batch_seq").collect())) or wanted(rows, *steps))
    got = sorted((r.batch_seq, r.leader, r.step) for r in match.batch_leaders(rows).collect())
    assert got == [(2, 1, match.IDENTITY), (3, 1, match.IDENTITY), (4, 1, match.CONTENT), (5, 2, match.CONTENT)]
    assert asked == [[1, 4, 5, 6]]


def test_a_step_makes_its_own_keys_only(spark):
    """A step that compares no observation reads none, and keys are made by generated code."""
    from postlake.operators import match

    item = [(1, "a", "https://a.example/1", dt.datetime(2026, 1, 2)), (2, "a", "https://a.example/1", dt.datetime(2026, 1, 1)), (3, "b", "https://a.example/1", T0)]
    jobs = spark.createDataFrame(item, "n long, source_key string, canonical_url string, first_seen_at timestamp").select(
        F.concat(F.lit("job-"), "n").alias("id"), "source_key", "canonical_url", "first_seen_at", F.lit("collected").alias("origin_type"), F.lit(False).alias("is_demo"),
        F.col("canonical_url").alias("source_url"), F.col("canonical_url").alias("apply_url"), F.col("n").cast("string").alias("source_item_id"),
        *[F.lit("x").alias(c) for c in ("institution", "country", "title", "content_hash")], F.lit(None).cast("date").alias("deadline"),
    )
    batch = jobs.select(F.col("first_seen_at").cast("long").alias("batch_seq"), F.lit(True).alias("explicit"), *[c for c in match.COMPARED if c in jobs.columns])
    broken = spark.range(1).select(*[F.raise_error(F.lit("observations were read")).cast("string").alias(c) for c in ("job_id", "source_key", "source_item_id")])
    got = {(r.job_id, r.step) for r in match.match_canonical(batch, jobs, broken).collect()}
    assert got == {("job-2", match.CANONICAL), ("job-3", match.CANONICAL)}
    assert "lambdafunction" not in match.wanted_keys(batch, *range(7))._jdf.queryExecution().optimizedPlan().toString()
