import datetime as dt

from pyspark.sql import functions as F

from postlake.functions.dates import iso_date
from postlake.functions.text import decode_entities, html_text, squeeze, words, words_of
from postlake.functions.urls import comparable, with_address


def run(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_entities_are_decoded_once(spark):
    got = run(
        spark,
        ["&amp;lt;", "&#38;amp;", "&#x41;&#8364;&#128512;", "&AMP;&Nbsp;&unknown;", "plain", None, "&#99999999999;"],
        decode_entities,
    )
    assert got == ["&lt;", "&amp;", "A€😀", "& &unknown;", "plain", None, "&#99999999999;"]


def test_html_text(spark):
    got = run(
        spark,
        [
            "<script>alert('no')</script><style>b{}</style><form><input value='s'></form>"
            "<img src='x'>A short summary &amp; safe text. <a href='j'>Apply</a><!-- gone -->",
            "<p>a<br>b</p>",
            None,
            "&lt;p&gt;escaped &lt;b&gt;tags&lt;/b&gt;",
        ],
        lambda c: html_text(c),
    )
    assert got == ["A short summary & safe text. Apply", "a b", "", "escaped tags"]
    assert run(spark, ["abc def"], lambda c: html_text(c, 4)) == ["abc"]
    assert run(spark, [" a \n b "], squeeze) == ["a b"]


def test_words_match_their_python_twin(spark):
    values = ["C++ and  R", "a-b_c", "", "Hello, World 2"]
    assert run(spark, values, words) == [words_of(v) for v in values]


def test_iso_date(spark):
    cases = {
        "2026-07-20": dt.date(2026, 7, 20),
        "2026-02-30": None,
        "2026-07-20T10:00:00Z": dt.date(2026, 7, 20),
        "2026-07-20T23:00:00-05:00": None,
        "Wed, 01 Jul 2026 10:00:00 GMT": dt.date(2026, 7, 1),
        "September 30, 2026": dt.date(2026, 9, 30),
        "3rd": None,
        "3 August 2026": dt.date(2026, 8, 3),
        "31 June 2026": None,
        "June 2nd, 2026": dt.date(2026, 6, 2),
        "": None,
        None: None,
    }
    assert run(spark, list(cases), iso_date) == list(cases.values())


def test_addresses(spark):
    rows = [
        (0, "HTTPS://Example.ORG:443/a//?utm_source=x&q=1&ref=2#top", "https://base.org/x/y?z=1"),
        (1, "/für?a=b", "https://base.org/x/y"),
        (2, "../up/./z", "https://base.org/x/y/w"),
        (3, "javascript:alert(1)", "https://base.org/"),
        (4, "https://u:p@h.org/", "https://base.org/"),
        (5, "?page=2", "https://base.org/list/"),
        (6, "//other.org:8080", "https://base.org/"),
        (7, "mailto:x@y.z", "https://base.org/"),
        (8, "rel.html", "https://base.org/dir/page"),
        (9, "rel.html", "https://base.org/dir/"),
    ]
    df = spark.createDataFrame(rows, "i int, v string, b string")
    df = with_address(with_address(df, "b", "base"), "v", "link", "base")
    got = [r.url for r in df.orderBy("i").select("link.url").collect()]
    assert got == [
        "https://example.org/a?q=1",
        "https://base.org/f%C3%BCr?a=b",
        "https://base.org/x/up/z",
        None,
        None,
        "https://base.org/list?page=2",
        "https://other.org:8080/",
        None,
        "https://base.org/dir/rel.html",
        "https://base.org/dir/rel.html",
    ]
    assert run(spark, ["https://A.org/x/#f", "ftp://a", "http://a.org"], comparable) == [
        "https://a.org/x", None, "http://a.org/",
    ]


def test_plain_addresses_and_texts_are_as_parsed_ones(spark):
    """What the short ways give is what the long ones give: the same with a port, or with markup around it."""
    paths = ("", "/", "/a", "/a//b//", "/a/../b", "/.x/y", "/a?x=1&&y", "/a?ref=1&x=2", "/a?refs=1", "/a?u=http://b/c?d", "?x=1", "/a?x=1&UTM_a")
    rows = spark.createDataFrame([(f"https://a.org{p}", f"https://A.org:443{p}") for p in paths], "v string, w string")
    both = with_address(with_address(rows, "v", "short"), "w", "long")
    assert [r.v for r in both.where("NOT (short <=> long)").collect()] == []
    texts = spark.createDataFrame([(" a b ",), ("a\u00a0b",), ("a  b",), ("",), ("\u3000a",), ("a\tb",), ("a &amp; b",)], "t string")
    got = texts.select("t", html_text(F.col("t"), None).alias("n"), html_text(F.concat(F.lit("<i>"), "t", F.lit("</i>")), None).alias("m"))
    assert [r.t for r in got.where("n <> m").collect()] == []
