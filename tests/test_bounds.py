"""Values past the sizes that operators once cut at."""

import json
import time

import pytest
from pyspark.sql import functions as F

from postlake.functions.text import nfkc
from postlake.operators.facts import clean_country, location_in, tags_of
from postlake.operators.normalize import item_identity
from postlake.operators.search import checked_range, normalize_filters
from postlake.operators.selection import reconcile_selection, saved_only
from postlake.sources.pages import anchors_of, content_range, flat_nodes, jsonld_postings, page_entries

LONG = "x" * 170


def test_long_ids_stay_apart(spark):
    jobs = spark.createDataFrame([(LONG + "a",), (LONG + "b",)], "id string")
    saved = spark.createDataFrame([("p", LONG + "a", 1)], "profile_id string, job_id string, pos int")
    assert [r.id for r in saved_only(jobs, saved).collect()] == [LONG + "a"]
    assert [r.job_id for r in reconcile_selection(saved, jobs).collect()] == [LONG + "a"]
    rows = spark.createDataFrame([("i" * 600 + e, None, None, "t", "") for e in "ab"], "source_item_id string, link string, guid string, title string, pub_date string")
    assert rows.select(item_identity(F.lit(None).cast("string")).alias("k")).distinct().count() == 2


def test_ranges_and_filters_are_refused():
    assert checked_range(100, 10_000) == (100, 10_000)
    for limit, offset in ((0, 0), (101, 0), (10, -1), (10, 10_001)):
        with pytest.raises(ValueError):
            checked_range(limit, offset)
    with pytest.raises(ValueError):
        normalize_filters({"keyword": "k" * 151})


def test_places(spark):
    texts = [
        ("Location: Paris, remote work. Location: Bonn, Germany.", "Germany", "Bonn"),
        ("Based in: Bonn, Germanyville, Germany", "Germany", ""),
        ("Location: St. Gallen, Switzerland", "Switzerland", "St. Gallen"),
    ]
    df = spark.createDataFrame(texts, "text string, country string, city string")
    got = df.select("country", "city", location_in(F.col("text"), F.lit(""), F.lit("")).alias("p")).collect()
    assert [(r.p.country, r.p.city) for r in got] == [(r.country, r.city) for r in got]
    named = spark.createDataFrame([("U.S.A.",), ("uk",), ("the netherlands",), ("Atlantis",), (None,), ("Not specified",)], "c string")
    assert [r[0] for r in named.select(clean_country(F.col("c"))).collect()] == ["United States", "United Kingdom", "Netherlands", "Atlantis", "", ""]


def test_all_tags(spark):
    df = spark.createDataFrame([([f"tag {n} " + "y" * 60 for n in range(15)],)], "c array<string>")
    assert len(df.select(tags_of(F.col("c"), F.lit(""), F.lit("Physics")).alias("t")).first().t) == 17


def test_ascii_text_passes_python_as_null(spark):
    df = spark.createDataFrame([("plain",), ("ﬁne",), (None,)], "c string").select(nfkc(F.col("c")).alias("c"))
    assert [r.c for r in df.collect()] == ["plain", "fine", None]


def test_long_and_deep_structured_data(spark):
    node = {"@type": "JobPosting", "title": "Postdoc", "description": "postdoctoral " + "z" * 320_000}
    deep = node
    for _ in range(12):
        deep = {"@graph": [[deep]]}
    assert len(flat_nodes(json.dumps(deep))) == 13 and flat_nodes("{") == []
    late = {"@type": "JobPosting", "title": "Opening", "description": "w " * 2000 + "a postdoctoral role. Deadline: 1 March 2027."}
    pages = spark.createDataFrame(
        [(n, "k", f"https://imechanica.org/{n}", f'<script type="application/ld+json">{json.dumps(x)}</script><h1>Else</h1>', "https://imechanica.org/l") for n, x in (("long", node), ("deep", deep), ("late", late))],
        "page_id string, source_key string, url string, html string, listing_url string",
    )
    got = {r.page_id: r for r in jsonld_postings(pages).collect()}
    assert {k: len(r.description) for k, r in got.items()} == {"long": 320_013, "deep": 320_013, "late": 4044}
    entries = {r.page_id: r for r in page_entries(pages).collect()}
    assert entries["late"].title == "Opening" and entries["late"].description_html.endswith("2027.")


def test_content_of_any_depth():
    inner = "<div>" * 9 + "x" + "</div>" * 9
    html = f"<div class='field--name-body'>{inner}<a href='/y'>y</a></div><p>out</p>"
    assert html[slice(*content_range(html))] == f"{inner}<a href='/y'>y</a>"


def test_links_in_linear_time():
    def page(n):
        return "<article>" + "<p>" + "".join(f'words and words <a href="/jobs/{k}">Apply {k}</a> ' for k in range(n)) + "</p></article>"

    def took(n):
        start = time.process_time()
        assert len(anchors_of(page(n))) == n
        return time.process_time() - start

    took(100)
    assert took(8000) < 8 * max(took(2000), 0.02)
    first, last = anchors_of(page(3))[0], anchors_of("<nav><a href=x>n</a></nav><h2>Apply</h2><li><a href='z'>q</a> here</li>")[-1]
    assert first["start_tag"] == '<a href="/jobs/0">' and not first["excluded"]
    assert (last["heading"], last["parent"], last["excluded"]) == ("Apply", "<li><a href='z'>q</a> here", False)




def test_patterns_are_tried_where_their_words_stand(spark):
    """A text that holds no pattern's word is told by fixed words alone; stems lose no match."""
    from postlake import rules
    from postlake.operators import facts

    for _, pattern in rules.RESEARCH_AREAS:
        assert all(stem for stem in facts._stems(pattern)), pattern
    assert facts._stems("materials? science|a(b)") == [""] and facts._stems("materials? science|robots*x") == ["material", "robot"]
    texts = ["MATERIAL SCIENCE in the U.S.A.", "in GREAT\n BRITAIN, ROBOTICS", "uK; aarhus,  denmark", "neutral", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(facts.area_of(F.col("text")), facts._named_country(F.col("text"))).collect()
    area = [r[0] for r in got]
    assert area == ["Materials Science", "Engineering", rules.OTHER_AREA, rules.OTHER_AREA, rules.OTHER_AREA]
    assert [r[1] for r in got] == ["United States", "United Kingdom", "United Kingdom", None, None]


def test_an_entry_is_read_once(spark, sources, monkeypatch):
    """Cleaning writes one table on its way and takes no address of a page apart again; parts agree with a second reading."""
    from postlake import schemas
    from postlake.functions.urls import with_address
    from postlake.operators import normalize

    written = []
    cut = normalize.cut
    monkeypatch.setattr(normalize, "cut", lambda df, label="step": written.append(label) or cut(df, label))
    links = [
        "https://www.imechanica.org/node/1/?ref=f#top", "HTTP://imechanica.org:80//a/../b/?utm_x=1&b=&&c#d", "https://www.imechanica.org/r?u=://www.imechanica.org/x", "https://imechanica.org",
        "https://imechanica.org/?source", "https://imechanica.org/a b/ü?q={1}", "https://www.imechanica.org/r/?u=1&ref=2&v=3", "ftp://x.org/", None,
    ]
    body = '<p>Postdoc, duration: two years, at the University of Oxford. Location: Bonn, Germany.</p><p><a href="y?utm_a=b&x=1">Apply now</a></p>'
    entry = {"source_key": "imechanica-job-channel", "title": "iMechanica: Postdoc", "description_html": body, "pub_date": "2026-01-01", "source_type": "rss"}
    columns = [c.split()[0] for c in schemas.ENTRY.replace("\n", " ").split(",")]
    rows = spark.createDataFrame([tuple({**entry, "link": link}.get(c) for c in columns) for link in links], schemas.ENTRY)
    out = {r.source_url: r for r in normalize.normalize_postings(rows, sources, __import__("datetime").datetime(2026, 1, 2)).collect()}
    assert written == ["read-entries"]
    assert out["https://imechanica.org/node/1"].apply_url == "https://imechanica.org/node/y?x=1"
    assert {(r.city, r.country, r.duration) for r in out.values()} == {("Bonn", "Germany", "2 years")}

    read = with_address(rows.select("link"), "link", "page").withColumn("page_url", F.when(F.col("page.host") == "www.imechanica.org", F.replace("page.url", F.lit("://www."), F.lit("://"))).otherwise(F.col("page.url")))
    again = with_address(normalize._with_own_address(read), "page_url", "again").collect()
    assert len(again) == len(links) and [r.own for r in again] == [r.again for r in again]


def test_blanks_and_stated_facts(spark):
    """Only what is no single space is replaced; the words found give the same parts as the whole text."""
    from postlake.functions.text import squeeze
    from postlake.operators.facts import deadline_in, duration_in

    texts = ["a b", " a  b\t", "a\nb", " a   b　", "\x0b", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(squeeze(F.col("t"))).collect()]
    assert got == ["a b", "a b", "a b", "a b", "", "", None]
    texts = [
        ("for a 24-month term, duration: one year", "1 year"), ("a two-year fixed-term position", "2 years"), ("MONTHS pass", ""), ("Duration: 3 monthsX; 18 month role", "18 months"),
        ("a 12-month role. Apply by 1 May 2027", "12 months"), (None, ""),
    ]
    rows = spark.createDataFrame(texts, "t string, d string").select("d", duration_in(F.col("t")).alias("got"), deadline_in(F.col("t")).alias("date")).collect()
    assert [r.got for r in rows] == [r.d for r in rows] and [str(r.date) for r in rows if r.date] == ["2027-05-01"]


def test_a_page_is_read_once_for_entry_and_advertisement(spark, monkeypatch):
    """What a page shows and states is written once; the advertisement it names is read from there."""
    from postlake.sources import pages as module

    written = []
    cut = module.cut
    monkeypatch.setattr(module, "cut", lambda df, label="step": written.append(label) or cut(df, label))
    node = json.dumps({"@type": "JobPosting", "title": "Postdoc", "description": "postdoctoral", "url": "https://careers.example.org/jobs/7"})
    rows = spark.createDataFrame(
        [("p", "k", "https://imechanica.org/1", f'<script type="application/ld+json">{node}</script><h1>Else</h1>', "https://imechanica.org/l"), ("q", "k", "https://imechanica.org/2", "<h1>Postdoc  two</h1>", None)],
        "page_id string, source_key string, url string, html string, listing_url string",
    )
    got = {r.page_id: (r.title, r.apply_url, r.application_reason) for r in page_entries(rows).collect()}
    assert written == ["read-pages"]
    assert got["p"] == ("Postdoc", "https://careers.example.org/jobs/7", "official_vacancy_link")
    assert got["q"] == ("Postdoc two", "https://imechanica.org/2", "source_detail_fallback")
