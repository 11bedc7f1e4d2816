import contextlib
import datetime as dt
import io

from pyspark.sql import functions as F

from postlake.functions.grams import containing
from postlake.operators import search
from postlake.operators.search_tables import search_requests

AS_OF = dt.date(2026, 3, 1)
JOB = "id string, title string, institution string, country string, city string, research_area string, language string, description string, tags array<string>, deadline date, is_active boolean, is_demo boolean, origin_type string, collection_state string"
WORDS = ["Physics of ice", "ice", "Straße", "PHYSICS", "50% off_road", "naïve Bayes", "a", "", None, "日本語の研究"]


def jobs(spark, n=240):
    rows = []
    for k in range(n):
        w = lambda step, k=k: WORDS[(k * step + k // 10) % len(WORDS)]
        due = None if k % 5 == 0 else AS_OF + dt.timedelta(days=k % 97 - 10)
        tags = None if k % 11 == 0 else [w(3) or "x", "tag"]
        rows.append((f"j{k}", w(1), w(7), ["Norway ", "norway", "Chad", None][k % 4], w(9), ["Ice", "Fire", None][k % 3], ["English/French", "French", "Malay", ""][k % 4], w(7), tags, due, k % 13 > 0, False, "collected", "stale" if k % 17 == 0 else "active"))
    return spark.createDataFrame(rows, JOB).repartition(3)


def requests(spark):
    keywords = ["", "ice", " Physics  of ICE ", "straße", "%", "_", "a", '","', "\\", "never there", "日本", "ce\nno", "icetag"]
    rows = [
        (f"r{n}", k, c, a, lang, d)
        for n, (k, c, a, lang, d) in enumerate(
            (k, c, a, lang, d) for k in keywords for c in ("", "NORWAY") for a in ("", " ice") for lang in ("", "french", "a") for d in (None, "7", "60", "open", "none")
        )
    ]
    return rows, spark.createDataFrame(rows, "request_id string, keyword string, country string, research_area string, language string, deadline string")


def test_every_request_against_its_own_filter(spark):
    table = jobs(spark).cache()
    rows, frame = requests(spark)
    got = {r.request_id: r.matching_jobs for r in search_requests(table, frame, AS_OF).collect()}
    assert len(got) == len(rows)
    base = search.public_dataset(table, AS_OF).where("is_active")
    for start in range(0, len(rows), 100):
        part = rows[start : start + 100]
        filters = [dict(keyword=" ".join((k or "").split()), country=c, research_area=a, language=lang, deadline=d) for _, k, c, a, lang, d in part]
        want = base.agg(*[F.count_if(F.coalesce(search.filter_predicate(f, AS_OF), F.lit(False))).alias(f"c{n}") for n, f in enumerate(filters)]).first()
        assert [got[r[0]] for r in part] == list(want)
    assert sum(v > 0 for v in got.values()) > 100 and 0 in got.values()


def test_no_nested_loops_in_the_plan(spark):
    _, frame = requests(spark)
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        search_requests(jobs(spark), frame, AS_OF).explain()
        containing(jobs(spark).selectExpr("id AS text_id", "title AS text"), frame.selectExpr("keyword AS needle")).explain()
    assert "NestedLoop" not in shown.getvalue() and "Cartesian" not in shown.getvalue()


def test_empty_tables(spark):
    _, frame = requests(spark)
    assert search_requests(jobs(spark).limit(0), frame, AS_OF).where("matching_jobs <> 0").isEmpty()
    assert search_requests(jobs(spark), frame.limit(0), AS_OF).isEmpty()


def test_needles_shorter_than_a_gram(spark):
    texts = ["", "a", "ab", "abc", "abcd", "ba", "é", "éa\nb", "aaaa", "x" * 50_000 + "needle" + "y" * 50_000]
    needles = ["a", "ab", "abc", "bcd", "é", "aa", "aaa", "needle", "zzz", "\n", "yn"]
    left = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    right = spark.createDataFrame([(n,) for n in needles] + [("a",), ("",)], "needle string")
    got = sorted((r.needle, r.text_id) for r in containing(left, right).collect())
    assert got == sorted((n, k) for n in needles for k, t in enumerate(texts) if n in t)


def test_pages_by_key_join_up(spark, tmp_path):
    import itertools

    rows = []
    for k, (posted, created) in enumerate(itertools.product([None, 1, 1, 2, 9], [None, 3, 3, 5, 8])):
        day = posted and AS_OF - dt.timedelta(days=posted)
        at = created and dt.datetime(2026, 1, created)
        rows += [(f"j{k}{x}", day, at, "Norway" if x else " NORWAY ", "Ice") for x in range(3)]
    form = "id string, posted_at date, created_at timestamp, country string, research_area string"
    fixed = dict(title="t", institution="i", city="c", language="English", description="d")
    table = spark.createDataFrame(rows, form).withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumns({
        "tags": F.array(F.lit("x")), "deadline": F.lit(None).cast("date"), "is_active": F.lit(True), "is_demo": F.lit(False),
        "origin_type": F.lit("collected"), "collection_state": F.lit("active"),
    })
    search.write_search_table(table, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    want = [r.id for r in table.orderBy(*search.newest_first()).collect()]
    got, last = [], None
    while True:
        page = search.search_after(stored, {"country": "norway"}, AS_OF, last, 7).collect()
        if not page:
            break
        got += [r.id for r in page]
        last = (page[-1].posted_at, page[-1].created_at, page[-1].id)
    assert got == want
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        search.search_after(stored, {"country": "norway"}, AS_OF, (AS_OF, dt.datetime(2026, 1, 1), "j"), 7).explain("formatted")
    pushed = "".join(line for line in shown.getvalue().split("PushedFilters:")[1:])
    assert "EqualTo(country_key,norway)" in pushed and "posted_at," in pushed
    assert "TakeOrderedAndProject" in shown.getvalue()
