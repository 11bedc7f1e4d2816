"""Documents to rows: feeds, listings, pages, API answers, robots files."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from postlake.operators.links import approved_links, canonical_links, robots_decision, same_address_groups
from postlake.operators.normalize import normalize_postings
from postlake.operators.classify import classify_postings, route_closed, validate_postings
from postlake.sources.api import api_details, api_listings
from postlake.sources.feeds import feed_items, feed_quarantine
from postlake.sources.listings import crawl_frontier, listing_links, portal_links, with_source
from postlake.sources.pages import (
    application_link, jsonld_postings, page_anchors, page_entries, portal_entries,
)

NOW = dt.datetime(2026, 8, 2, 12)
FEED, ORNL, LBL, EMBL = (
    "imechanica-job-channel", "ornl-postdoctoral-jobs", "berkeley-lab-postdoctoral", "embl-postdoctoral-jobs",
)


def item(n, title="Postdoc in tests", text="A postdoctoral opening.", extra=""):
    return (
        f"<item><title>{title}</title><link>https://imechanica.org/node/{n}</link>"
        f"<guid isPermaLink='false'>g-{n}</guid><pubDate>Wed, 01 Jul 2026 10:00:00 GMT</pubDate>"
        f"<description>{text}</description>{extra}</item>"
    )


def rss(*items):
    return f"<rss version='2.0'><channel><title>T</title>{''.join(items)}</channel></rss>"


def test_feed_items(spark):
    rdf = (
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/"'
        ' xmlns:content="http://purl.org/rss/1.0/modules/content/"><item><title>R</title><link>https://a.org/r</link>'
        "<dc:date>2026-07-01</dc:date><description>short</description>"
        "<content:encoded><![CDATA[<p>long</p>]]></content:encoded></item></rdf:RDF>"
    )
    docs = [
        ("empty", rss()),
        ("one", rss(item(1, extra="<category> Mechanics </category>"))),
        ("many", rss(item(1), item(2))),
        ("bare", rss("<item><title>Only title</title></item>")),
        ("broken", "<rss><channel>"),
        ("doctype", "<!DOCTYPE x [<!ENTITY e 'v'>]><rss><channel></channel></rss>"),
        ("blank", "  "),
        ("rdf", rdf),
    ]
    df = spark.createDataFrame([(d, FEED, x) for d, x in docs], "doc_id string, source_key string, xml string")
    items = {}
    for r in feed_items(df).orderBy("doc_id", "pos").collect():
        items.setdefault(r.doc_id, []).append(r)
    assert {k: len(v) for k, v in items.items()} == {"one": 1, "many": 2, "bare": 1, "rdf": 1}
    one = items["one"][0]
    assert (one.guid, one.categories, one.pub_date) == ("g-1", ["Mechanics"], "Wed, 01 Jul 2026 10:00:00 GMT")
    assert (items["bare"][0].link, items["bare"][0].pub_date) == ("", "")
    assert (items["rdf"][0].description_html, items["rdf"][0].pub_date) == ("<p>long</p>", "2026-07-01")
    bad = {r.doc_id: r.rejected for r in feed_quarantine(df).collect()}
    assert bad == {"broken": "invalid XML", "doctype": "prohibited declaration"}


def test_listing_links(spark, sources):
    html = """<html><body><nav><a href="/node/9">no</a></nav>
      <article><h2><a href="/postdoc-one">Postdoc one</a></h2><time datetime="2026-07-01"></time><p>Text</p></article>
      <article><h3><a href='https://imechanica.org/postdoc-two#x'>Two</a></h3></article>
      <article><h2><a href="/postdoc-one">Again</a></h2></article>
      <article><h2><a href="/user/7">Profile</a></h2></article>
      <article><h2><a href="https://elsewhere.org/postdoc-x">Other host</a></h2></article>
      <article><h2><a href="/node/1?x=1">Query</a></h2></article>
      <ul class="js-pager"><a href="?page=1">2</a><a href="?page=1">next</a><a href="?page=x">bad</a><a href="/other?page=1">o</a></ul>
      </body></html>"""
    pages = spark.createDataFrame(
        [("p", FEED, "https://imechanica.org/taxonomy/term/73", html)],
        "page_id string, source_key string, url string, html string",
    )
    got = listing_links(pages, sources).orderBy("kind", "pos").collect()
    assert [(r.kind, r.url, r.title) for r in got] == [
        ("detail", "https://imechanica.org/postdoc-one", "Postdoc one"),
        ("detail", "https://imechanica.org/postdoc-two", "Two"),
        ("page", "https://imechanica.org/taxonomy/term/73?page=1", ""),
    ]
    assert got[0].submitted_at == "2026-07-01" and got[0].excerpt == "Postdoc one Text"


def test_portal_links_and_frontier(spark, sources):
    html = """<a href="/job/Oak-Ridge-Postdoc/11/">Postdoctoral fellow</a> <a href="/job/Oak-Ridge-Tech/12/">Technician</a>
      <a href="/job/Oak-Ridge-Postdoc/11">Repeat</a> <a href="/job/Empty/13/"> </a>
      <a href="/go/Postdoctoral-Jobs/4537100/?startrow=25">Next</a> <a href="/about">About</a>"""
    url = "https://jobs.ornl.gov/go/Postdoctoral-Jobs/4537100/"
    pages = spark.createDataFrame([("p", ORNL, url, html)], "page_id string, source_key string, url string, html string")
    links = portal_links(pages, sources)
    got = [(r.kind, r.url, r.title) for r in links.orderBy("pos").collect()]
    assert got == [
        ("detail", "https://jobs.ornl.gov/job/Oak-Ridge-Postdoc/11", "Postdoctoral fellow"),
        ("detail", "https://jobs.ornl.gov/job/Oak-Ridge-Tech/12", "Technician"),
        ("page", "https://jobs.ornl.gov/go/Postdoctoral-Jobs/4537100?startrow=25", "Next"),
    ]
    many = spark.range(40).select(
        F.lit(EMBL).alias("source_key"), F.format_string("https://e.org/%02d", "id").alias("url"),
        F.when(F.col("id") >= 35, "A postdoc").otherwise("Other").alias("title"), F.col("id").cast("int").alias("pos"),
    )
    decisions = spark.createDataFrame([("https://e.org/35", False), ("https://e.org/36", True)], "url string, allowed boolean")
    front = crawl_frontier(many, sources, decisions).orderBy("rank").collect()
    assert [r.url[-2:] for r in front] == ["35", "36", "37", "38", "39", "00", "01", "02"]
    assert [r.reason for r in front][:2] == ["robots", None]


def test_api(spark, sources):
    listing = """{"total":4,"jobPostings":[
      {"title":"Postdoc A","externalPath":"/job/A_1","locationsText":"Heidelberg, DE","bulletFields":["JR1"]},
      {"title":"Postdoc A2","externalPath":"/job/A_2","locationsText":"Rome","bulletFields":["JR1"]},
      {"title":"B","externalPath":null}, {"title":"C","externalPath":"/job/C"}]}"""
    docs = spark.createDataFrame([("d", EMBL, listing)], "doc_id string, source_key string, json string")
    rows = api_listings(docs)
    got = [(r.source_item_id, r.title, r.pos) for r in rows.orderBy("pos").collect()]
    assert got == [("JR1", "Postdoc A2", 0), ("/job/C", "C", 3)]
    detail = spark.createDataFrame(
        [
            (EMBL, "/job/A_2", '{"jobPostingInfo":{"jobDescription":"<p>Postdoc work</p>","location":"EMBL Rome site","startDate":"2026-07-01","posted":true,"canApply":true,"timeType":"Full time"}}'),
            (EMBL, "/job/C", '{"jobPostingInfo":{"title":"Own","jobReqId":"JR9","jobDescription":"Job is no longer available","externalUrl":"https://evil.org/x"}}'),
            (EMBL, "/job/Z", '{"jobPostingInfo":{"title":"Z","posted":false,"location":"Lyon, France"}}'),
        ],
        "source_key string, external_path string, json string",
    )
    got = {r.title: r for r in api_details(detail, rows, sources).collect()}
    a = got["Postdoc A2"]
    assert (a.source_item_id, a.city, a.country, a.closed) == ("JR1", "Rome", "Italy", False)
    assert a.link == "https://embl.wd103.myworkdayjobs.com/EMBL/job/A_2"
    assert (got["Own"].source_item_id, got["Own"].closed, got["Own"].link) == ("JR9", True, None)
    assert (got["Z"].city, got["Z"].country, got["Z"].closed, got["Z"].source_item_id) == ("Lyon", "", True, "/job/Z")


POSTING = (
    '{"@context":"https://schema.org","@type":"JobPosting","title":"Postdoctoral Associate in Robotics",'
    '"description":"A postdoctoral robotics vacancy.","datePosted":"2026-07-21","validThrough":"2026-10-01",'
    '"hiringOrganization":{"@type":"Organization","name":"Robotics Institute"},"jobLocation":{"@type":"Place",'
    '"address":{"addressLocality":"Toronto","addressCountry":"Canada"}},"url":"https://careers.example.edu/jobs/robotics-8",'
    '"identifier":{"value":"robotics-8"}}'
)


def page(script="", body="", heading="Vacancy"):
    head = f'<script type="application/ld+json">{script}</script>' if script else ""
    return f"<html lang='en-GB'><head>{head}</head><body><main><article><h1>{heading}</h1>{body}</article></main></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    graph = '{"@graph":[{"@type":"Organization"},{"@type":["JobPosting"],"title":"Postdoc in Biology","description":"postdoctoral biology","hiringOrganization":"Lab"}]}'
    nested = f'[[{{"@graph":{{"@graph":[{POSTING}]}}}}]]'
    body = "<div class='field field--name-body x'><div>Postdoc physics</div> vacancy at Example Laboratory.</div>"
    rows = [
        ("plain", page(POSTING)), ("graph", page(graph)), ("nested", page(nested)),
        ("bad", page('{"@type":"JobPosting", oops}', body + "<p>Outside</p>", "Postdoc in Physics")),
        ("other", page('{"@type":"JobPosting","title":"Lecturer","description":"teaching"}', "<time datetime='2026-07-16'></time>", "Postdoc seen")),
    ]
    return spark.createDataFrame(
        [(i, FEED, f"https://imechanica.org/{i}", h, "https://imechanica.org/taxonomy/term/73") for i, h in rows],
        "page_id string, source_key string, url string, html string, listing_url string",
    )


def test_jsonld(pages):
    got = {r.page_id: r for r in jsonld_postings(pages).collect()}
    assert set(got) == {"plain", "graph", "nested", "other"}
    p = got["plain"]
    assert (p.institution, p.city, p.country, p.identifier, p.url, p.deadline) == (
        "Robotics Institute", "Toronto", "Canada", "robotics-8", "https://careers.example.edu/jobs/robotics-8", "2026-10-01",
    )
    assert (got["graph"].institution, got["graph"].country) == ("Lab", "")
    assert got["nested"].title == p.title


def test_page_entries(pages):
    got = {r.page_id: r for r in page_entries(pages).collect()}
    assert got["plain"].title == "Postdoctoral Associate in Robotics"
    assert got["plain"].apply_url == "https://careers.example.edu/jobs/robotics-8"
    assert got["bad"].title == "Postdoc in Physics"
    assert got["bad"].description_html == "Postdoc physics vacancy at Example Laboratory."
    assert (got["other"].title, got["other"].pub_date) == ("Postdoc seen", "2026-07-16")
    assert got["other"].apply_url == "https://imechanica.org/other"


def test_application_link(spark):
    chosen = """<article><header><nav><a href="/lists/open-posts">All posts</a></nav></header>
      <p>We model tides. See <a href="https://tides.example/">our group</a>, <a href="mailto:tides@example.org">write</a>
      or read <a href="/people/kim">about Kim</a> and <a href="/lists/open-posts?page=2">older posts</a>.</p>
      <h3>Sending your papers</h3><p>To join us, submit your application over <a href="https://posts.example.ac/vacancies/oceans-5">our staff portal</a> by spring.</p>
      </article><footer><a href="https://posts.example.ac/vacancies/none">Apply</a></footer>"""
    outside = """<article><aside><p><a href="https://posts.example.ac/jobs/10">Apply here</a></p></aside><p>No link in the text.</p>
      <section id="comments"><a href="https://posts.example.ac/jobs/11">Apply here</a></section></article>"""
    tied = """<article><ul><li><a href="https://z.example.ac/jobs/3">Apply here</a></li><li><a href="https://m.example.ac/jobs/3?utm_source=mail&amp;lang=en">Apply here</a></li>
      <li><a href="https://m.example.ac/jobs/3.pdf">All about the job</a></li></ul></article>"""
    df = spark.createDataFrame(
        [(i, f"https://imechanica.org/{i}", h, "https://imechanica.org/lists/open-posts") for i, h in (("chosen", chosen), ("outside", outside), ("tied", tied))],
        "page_id string, url string, html string, listing_url string",
    )
    anchors = page_anchors(df)
    last = anchors.where("page_id = 'chosen'").orderBy(F.desc("pos")).first()
    assert last.heading_text == "Sending your papers"
    assert last.parent_text == "To join us, submit your application over our staff portal by spring."
    got = {r.page_id: r for r in application_link(anchors, df).collect()}
    assert (got["chosen"].apply_url, got["chosen"].reason) == ("https://posts.example.ac/vacancies/oceans-5", "explicit_apply_link")
    assert got["chosen"].score == 300 + 30 + 25 + 20
    assert (got["outside"].apply_url, got["outside"].reason) == ("https://imechanica.org/outside", "source_detail_fallback")
    assert got["tied"].apply_url == "https://m.example.ac/jobs/3?lang=en"


def test_portal_entries(spark, sources):
    rows = [
        ("v", ORNL, "https://jobs.ornl.gov/job/Oak-Ridge-Postdoc/123/", page(body="<div>Postdoctoral text.</div>", heading=""), "From listing"),
        ("c", LBL, "https://jobs.lbl.gov/jobs/postdoc-fellow-77", page(body="<p>Applications closed.</p>", heading="Postdoc"), ""),
    ]
    df = spark.createDataFrame(rows, "page_id string, source_key string, url string, html string, listing_title string")
    got = {r.page_id: r for r in portal_entries(df, sources).collect()}
    v, c = got["v"], got["c"]
    assert (v.title, v.source_item_id, v.source_language, v.city, v.closed) == ("From listing", "123", "en", "Oak Ridge", False)
    assert (c.source_item_id, c.institution, c.closed) == ("77", "Lawrence Berkeley National Laboratory", True)


def test_robots(spark):
    files = [
        ("a.org", "User-agent: *\nDisallow: /\n\nUser-agent: TestBot\nUser-agent: other\nAllow: /open # c\nDisallow: /open/closed\nDisallow: /*.pdf$\nCrawl-delay: 2\n", None),
        ("b.org", "User-agent: *\nDisallow:\nAllow: /x\nDisallow: /x\n", None),
        ("c.org", "", "search=no, ai=yes"),
    ]
    fs = spark.createDataFrame(files, "host string, text string, content_signal string")
    links = ["https://a.org/open/1", "https://a.org/open/closed/1", "https://a.org/other", "https://a.org/f.pdf", "https://a.org/f.pdf?x", "https://b.org/x/1", "https://b.org/", "https://c.org/", "https://unknown.org/"]
    df = spark.createDataFrame([(u,) for u in links], "url string")
    got = {r.url: (r.allowed, r.rule, r.crawl_delay) for r in robots_decision(df, fs, "TestBot").collect()}
    assert got == {
        links[0]: (True, "/open", 2.0), links[1]: (False, "/open/closed", 2.0), links[2]: (True, None, 2.0),
        links[3]: (False, "/*.pdf$", 2.0), links[4]: (True, None, 2.0), links[5]: (True, "/x", None),
        links[6]: (True, None, None), links[7]: (False, "search=no", None), links[8]: (True, None, None),
    }


def decided(text, target, agent):
    """Robots rules for one address, rule by rule."""
    groups, last = [], None
    for line in text.removeprefix("\ufeff").split("\n"):
        line = re.sub(r"\s+#.*$", "", line.rstrip("\r")).strip(" ")
        name, colon, value = line.partition(":")
        name, value = name.strip(" ").lower(), value.strip(" ")
        if not colon or name not in ("user-agent", "allow", "disallow", "crawl-delay"):
            continue
        if name == "user-agent":
            if last != "user-agent":
                groups.append(([], []))
            groups[-1][0].append(value.lower())
        elif groups and name != "crawl-delay" and value:
            groups[-1][1].append((name == "allow", value))
        last = name if groups else None
    chosen = [g for g in groups if agent in g[0]] or [g for g in groups if "*" in g[0]]
    hits = []
    for allow, path in (r for g in chosen for r in g[1]):
        body = re.escape(path.removesuffix("$")).replace(r"\*", ".*")
        if re.match(body + ("$" if path.endswith("$") else ""), target):
            hits.append((len(re.sub("[*$]", "", path)), allow, path))
    return max(hits, default=(0, True, None))[1:]


def test_long_rule_files_against_rule_by_rule(spark):
    import random

    rnd = random.Random(9)
    part = lambda: "/" + rnd.choice(["a", "b", "ab", "c.d", "e+f", "x"])
    files, targets = {}, {}
    for n in range(12):
        lines = ["Disallow: /before-any-agent"]
        for _ in range(rnd.randrange(1, 4)):
            lines += [f"User-agent: {rnd.choice(['*', 'TestBot', 'other'])}" for _ in range(rnd.randrange(1, 3))]
            for _ in range(rnd.randrange(8)):
                path = "".join(part() for _ in range(rnd.randrange(3))) + rnd.choice(["", "", "/", "*", "*.pdf$", "$", "?q"])
                lines.append(rnd.choice([f"Allow: {path}", f"Disallow: {path} # why", "Sitemap: x", "", "Crawl-delay: 3", "Host: h"]))
        files[f"h{n}.org"] = "\n".join(lines)
        targets[f"h{n}.org"] = {"".join(part() for _ in range(rnd.randrange(1, 5))) + rnd.choice(["", "/", ".pdf", "?q=1"]) for _ in range(40)}
    big = ["User-agent: *", "Disallow: /"] + [f"{'Allow' if k % 3 else 'Disallow'}: /p/{k}" for k in range(50_000)]
    files["big.org"] = "\n".join(big)
    targets["big.org"] = {f"/p/{rnd.randrange(60_000)}/x" for _ in range(60)}
    fs = spark.createDataFrame([(h, t, None) for h, t in files.items()], "host string, text string, content_signal string")
    links = [(f"https://{h}{t}", h, t) for h, ts in targets.items() for t in ts]
    got = {r.url: (r.allowed, r.rule) for r in robots_decision(spark.createDataFrame([(u,) for u, *_ in links], "url string"), fs, "TestBot").collect()}
    small = {u: decided(files[h], t, "testbot") for u, h, t in links if h != "big.org"}
    assert {u: got[u] for u in small} == small
    rules_of = {f"/p/{k}": k % 3 != 0 for k in range(50_000)}
    for u, h, t in links:
        if h == "big.org":
            path = max((t[:k] for k in range(1, len(t) + 1) if t[:k] in rules_of or t[:k] == "/"), key=len)
            assert got[u] == (rules_of.get(path, False), path)


def test_links(spark, sources):
    urls = ["https://imechanica.org/node/5", "https://imechanica.org/node/5/", "http://imechanica.org/node/5",
            "https://x.org/node/5", "https://imechanica.org/taxonomy/term/73?page=2", "https://imechanica.org/a.pdf",
            "https://imechanica.org/taxonomy/term/73?sort=a", "https://imechanica.org/user/1", "ftp://x"]
    df = spark.createDataFrame([(i, FEED, u) for i, u in enumerate(urls)], "i int, source_key string, url string")
    got = [(r.kind, r.reject_reason) for r in approved_links(df, sources).orderBy("i").collect()]
    assert got == [("detail", None), ("detail", None), (None, "not secure"), (None, "host not approved"),
                   ("listing", None), (None, "asset"), (None, "listing parameters"), (None, "path not approved"), (None, "not a web address")]
    groups = same_address_groups(canonical_links(df)).collect()
    assert [(g.canonical_url, g.forms, g.links) for g in groups] == [("https://imechanica.org/node/5", 2, 2)]


def test_hosts_in_rows(spark, sources):
    rows = [(0, "a", "https://x.org/d/5"), (1, "a", "https://X.org/d/5"), (2, "a", "https://y.org/d/5"), (3, "b", "https://y.org/d/5"), (4, "b", "https://x.org/d/5"),
            (5, "a", "ftp://x"), (6, "a", "http://x.org/d/5"), (7, "a", "https://x.org/list?page=2"), (8, "c", "https://x.org/d/5"), (9, "a", "https://x.org/e")]
    df = spark.createDataFrame(rows, "i int, source_key string, url string")
    dim = spark.createDataFrame([(k, "/list", ["^/d/"]) for k in "abc"], "source_key string, listing_path string, detail_patterns array<string>")
    hosts = spark.createDataFrame([("a", "x.org"), ("a", "x.org"), ("b", "y.org"), ("a", None)], "source_key string, host string")
    by_rows = [(r.i, r.kind, r.reject_reason) for r in approved_links(df, dim, hosts=hosts).orderBy("i").collect()]
    arrays = spark.createDataFrame([("a", ["x.org"]), ("b", ["y.org"]), ("c", [])], "source_key string, hosts array<string>")
    assert by_rows == [(r.i, r.kind, r.reject_reason) for r in approved_links(df, dim.join(arrays, "source_key")).orderBy("i").collect()]
    assert [k for _, k, _ in by_rows] == ["detail", "detail", None, "detail", None, None, None, "listing", None, None]


def test_query_keeps_no_array_of_hosts(spark):
    from postlake.plans.queries import load_all

    plan = load_all()["approved_links"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def entry(**kw):
    base = dict(source_key=FEED, title="Postdoc in chemistry", description_html="A postdoctoral position.", link="https://www.imechanica.org/node/1",
                guid="g", source_item_id=None, pub_date="Wed, 01 Jul 2026 10:00:00 GMT", categories=[], institution="", country="", city="",
                deadline="", duration="", employment_type="", apply_url=None, source_language=None, source_type="rss", closed=False)
    return {**base, **kw}


def test_normalize(spark, sources):
    from postlake.schemas import ENTRY

    rows = [
        entry(description_html="Tides and salt. Application deadline: October 12, 2026. The position is for 30 months."),
        entry(link="https://imechanica.org/node/2", title="iMechanica Job Channel: Postdoc at University of Bergen", pub_date="2027-01-01",
              description_html="Deep learning for waves. Location: Bergen, Norway. Closing date: 21 May 2026. Duration: three years. <a href='https://posts.example.ac/jobs/waves-9?utm_medium=rss'>Apply here</a>"),
        entry(link="https://imechanica.org/node/3", institution="the McGill University, Canada", country="USA", deadline="2026-02-30", categories=["AI", "ai", "Soft  matter"]),
        entry(link="https://imechanica.org/node/4", description_html="Location: Lund, Sweden. We offer a 3-year postdoctoral appointment at the Northern Sea Institute, in biology with some robotics."),
        entry(link="", guid="", title="No link", pub_date=""),
    ]
    from postlake import schemas
    names = [c.strip().rsplit(" ", 1)[0] for c in schemas.ENTRY.replace("\n", " ").split(",")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ENTRY)
    jobs = normalize_postings(df, sources, NOW)
    got = {r.source_url: r for r in jobs.collect()}
    one = got["https://imechanica.org/node/1"]
    assert (one.deadline, one.duration, one.research_area, one.posted_at) == (dt.date(2026, 10, 12), "30 months", "Chemistry", dt.date(2026, 7, 1))
    assert one.id.startswith("collected-") and len(one.id) == 42 and one.source_item_id == one.source_url
    two = got["https://imechanica.org/node/2"]
    assert (two.title, two.institution, two.country, two.city) == ("Postdoc at University of Bergen", "University of Bergen", "Norway", "Bergen")
    assert (two.deadline, two.duration, two.posted_at) == (dt.date(2026, 5, 21), "3 years", dt.date(2026, 8, 2))
    assert two.apply_url == "https://posts.example.ac/jobs/waves-9"
    three = got["https://imechanica.org/node/3"]
    assert (three.institution, three.country, three.deadline) == ("McGill University", "United States", None)
    assert three.tags == ["AI", "Soft matter", "Chemistry", "Postdoctoral"]
    four = got["https://imechanica.org/node/4"]
    assert (four.country, four.city, four.duration, four.institution) == ("Sweden", "Lund", "3 years", "Northern Sea Institute")
    assert four.tags == ["Engineering", "Postdoctoral", "Robotics", "Biology", "Chemistry"]
    checked = {r.source_url: r.errors for r in validate_postings(jobs).collect()}
    assert checked["https://imechanica.org/node/1"] == []
    assert "source_url must be HTTP or HTTPS" in checked[None]


def test_classify(spark):
    cases = [
        ("Postdoc in X", "text", "accepted"), ("Job", "a Post-Doctoral role", "accepted"), ("Job", "text", "no_term"),
        ("Postdoc RSS feed", "x", "informational"), ("Opening", "not a postdoc", "negated"),
        ("Assistant Professor", "with a postdoc", "excluded"), ("Postdoc or professor", "", "accepted"), ("épostdoc", "", "accepted"),
    ]
    df = spark.createDataFrame([(i, "s", t, d) for i, (t, d, _) in enumerate(cases)], "i int, source_key string, title string, description_html string")
    got = [r.reason for r in classify_postings(df).orderBy("i").collect()]
    assert got == [c[2] for c in cases]
    both = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, closed boolean")
    open_, closed = route_closed(both)
    assert (open_.count(), closed.count()) == (2, 1)


def test_sources_are_joined_without_a_product(spark, sources):
    """A key that is the same for all pages leaves a join without a key: every page must still be read once."""
    rows = spark.range(10_000_000).select(
        F.col("id").alias("page_id"), F.lit(ORNL).alias("source_key"), F.lit("https://jobs.ornl.gov/go/x/").alias("url"), F.lit("<a href='/job/a/1/'>a</a>").alias("html"), F.lit("").alias("listing_title"),
    )
    for found in (portal_links(rows, sources), listing_links(rows, sources), portal_entries(rows, sources)):
        assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_source_stay_apart(spark, sources):
    """All rows of a source meet its one row of the dimension where they are, not in one task."""
    key = F.when(F.col("id") >= 0, FEED).otherwise(ORNL)
    rows = spark.range(10_000_000).select(key.alias("source_key"))
    assert "Exchange hashpartitioning" not in with_source(rows, sources)._jdf.queryExecution().executedPlan().toString()


def test_entries_are_read_once(spark, sources):
    """Bodies, links and entries start from one table of the entries read, so none reads them again."""
    from postlake import schemas

    fields = {f.name: f.dataType for f in spark.createDataFrame([], schemas.ENTRY).schema}
    given = {"source_key": FEED, "title": "Postdoc", "link": "https://imechanica.org/node/1", "description_html": "Tides"}
    rows = spark.range(3).select(*[F.lit(given.get(n)).cast(t).alias(n) for n, t in fields.items()])
    jobs = normalize_postings(rows, sources, NOW)
    assert "Range (" not in jobs._jdf.queryExecution().executedPlan().toString()
    assert jobs.count() == 3


def test_small_deliveries_are_dealt_to_all_cores(spark, monkeypatch):
    from postlake import session

    rows = spark.range(1000, numPartitions=1)
    dealt = session.spread(rows)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))
    monkeypatch.setattr(session, "SPLIT", 0)  # a table large enough is left as it is
    assert session.spread(rows).rdd.getNumPartitions() == 1
