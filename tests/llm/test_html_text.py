import html
import re

from postlake.llm import html_text

WORDS = "Plain words that go on for a while so that this block has some weight in the page. "
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body class="ad">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">{WORDS}</div>
<main><article><header><h1>The&nbsp;title</h1><p>by me</p></header><p>{WORDS}<b>bold</b>text &amp; &#233;<br>next
  line<p>Short.</p><aside>{WORDS * 3}</aside><form><p>{WORDS}</p></form><ul><li>one<li>two</ul>
<div id="comments"><p>{WORDS * 4}</p></div></article></main>
<div class="sidebar">{WORDS * 5}</div><footer>&copy; us</footer>"""


def test_article_of_a_page():
    w = WORDS.strip()
    assert html_text.main_text(PAGE).split("\n") == ["The title", f"{w} boldtext & é next line", "Short.", "one", "two"]


def test_without_article():
    page = "<body><div class=menu>" + "<a href=x>link</a> " * 8 + "</div>" + "".join(f"<p>{WORDS * 3}{n}</p>" for n in range(6)) + "<div><a>x</a><a>y</a><a>z</a></div><div class='footer'>end</div>"
    assert html_text.main_text(page) == "\n".join(f"{WORDS * 3}{n}" for n in range(6))


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article>Hi.</article>"), (3, "u", "<<<>&<p"), (4, "u", "plain"), (5, "u", "<article><p>" + "a b  c\n" * 60_000), (5, "u", "<article><p>" + "a b  c\n" * 60_000)]
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.main_texts(pages).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert by_id[1].text == by_id[2].text == "" and by_id[1].n_chars == 0
    assert by_id[None].text == "Hi."
    assert by_id[5].text == ("a b c " * 60_000).strip()
    assert html_text.main_texts(pages.where("page_id = 99")).count() == 0


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text.main_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>|<br>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


NAMED = f"""<body><article><h1>Title</h1><section id="related-work"><h2 id="navigation-systems">Navigation systems</h2><p class="header-files">{WORDS}</p></section>
<div id="notice-and-choice"><h3 id="comments">On comments</h3><p>{WORDS}<a href="#1">a link</a></p></div><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p>
<div class="related-stories-box"><p><a href="/1">Another story of ours</a> <a href="/2">And one more</a></p></div><div class="share-buttons">Tell all</div>
<div class="comment_list"><p>{WORDS * 2}</p></div><div id="comment-17"><p>{WORDS * 2}</p></div><div class="menu">{WORDS}</div></article></body>"""


def test_names_made_from_headings_keep_their_text():
    w = WORDS.strip()
    want = ["Title", "Navigation systems", w, "On comments", f"{w} a link", "So x=1."]
    assert html_text.main_text(NAMED).split("\n") == want
    page = f'<body><h1>Title</h1><section id="related-work"><p>{WORDS * 3}</p></section><p class="header-files">{WORDS * 3}</p></body>'
    assert html_text.main_text(page).count("Plain words") == 6


def test_head_without_an_end():
    body = f"<h1>Title</h1><p>{WORDS}</p><p>Short.</p>"
    want = ["Title", WORDS.strip(), "Short."]
    head = "<!DOCTYPE html><html><head><meta charset=utf-8><link rel=x><style>p{}</style><noscript><p>No script</p></noscript>"
    for start in (f"{head}<title>T</title><body>", f"{head}<title>T</title>", f"{head}<title>T<body>", f"{head}<title>T", f"{head}<title>A <b> tag</title><base href=x>", f"{head}<title>A <b> tag</title></head>", "<title>T<body>", "<title>T"):
        for end in ("", "</body></html>"):
            assert html_text.main_text(f"{start}<article>{body}</article>{end}").split("\n") == want, start
            assert html_text.main_text(start + body + end).split("\n")[:2] == want[:2], start
    assert html_text.main_text("<head><title>T</title> plain " + WORDS * 3).startswith("plain Plain")
    assert html_text.main_text("<head><title>T</title><img src=x>" + WORDS * 3).startswith("Plain")
    assert html_text.main_text(f"<body><article><p>{WORDS}<svg><title>Icon</title><path/></svg>more</p></article>").split() == f"{WORDS}more".split()


def test_nothing_is_lost_between_long_paragraphs():
    long = [f"{WORDS * 4}{n}" for n in range(2)]
    short = "Yes. No. Three. Four. Five. Six. Seven.".split()
    page = f"<body><p>{long[0]}</p>" + "".join(f"<p>{x}</p>" for x in short) + f"<p>{long[1]}</p></body>"
    assert html_text.main_text(page).split("\n") == [long[0], *short, long[1]]
    items = [f"{n} spoons" for n in range(12)]
    recipe = "<body><div class=nav><a href=x>Home</a></div><div><h1>Soup</h1><ul>" + "".join(f"<li>{x}" for x in items) + f"</ul><p>{long[0]}</p></div></body>"
    assert html_text.main_text(recipe).split("\n") == ["Soup", *items, long[0]]


def test_wrappers_set_nothing_aside():
    w = WORDS.strip()
    body = f"<h1>Title</h1><p>{WORDS}</p><p>Short.</p>"
    menu = "<ul class=menu>" + "<li><a href=x>Some page</a>" * 9 + "</ul>"
    for inner in (body, f"<article>{body}</article>", f"<main>{body}</main>"):
        for wrapped in (f"<form action=x>{menu}{inner}</form>", f"<div class='page header'>{inner}</div>{menu}", f"<div role=form>{inner}{menu}</div>"):
            assert html_text.main_text(f"<body>{wrapped}</body>").split("\n") == ["Title", w, "Short."], wrapped
    assert html_text.main_text(f"<body><div class=widget><article>{body}</article></div><p>Other.</p></body>").split("\n") == ["Title", w, "Short."]
    assert html_text.main_text(f"<body><article><p>{WORDS}</p></article><div class=comments><article><p>{WORDS * 9}</p></article></div></body>") == w
    assert html_text.main_text(f"<body><div hidden><p>{WORDS * 9}</p></div><p>{WORDS}</p></body>") == w


def test_ids_named_after_their_heading():
    w = WORDS.strip()
    page = f"""<body><article><h1>Title</h1><section id="cookies"><h2>Cookies</h2><p>{WORDS}</p></section><div id="menu"><h3>The Menu</h3><p>{WORDS}</p></div>
    <div id="related"><h3>Related</h3><a href=1>Another one</a> <a href=2>One more</a></div><div id="comments"><h3>Comments</h3><p>{WORDS}</p></div></article></body>"""
    assert html_text.main_text(page).split("\n") == ["Title", "Cookies", w]


def test_links_around_nested_tags():
    line = html_text.lines_of("<p><a href=x><b><i><u><em><span>deep link</span></em></u></i></b></a> text")[0]
    assert (line.linked, line.size) == (8, 12)


def plain_lines(page):
    """Blocks outside of named elements of a page without crossing tags, by splitting at tags."""
    for name in ("header", "footer", "nav", "aside", "script", "style", "title"):
        page = re.sub(rf"<{name}\b.*?</{name}>", "\n", page, flags=re.DOTALL)
    page = re.sub(r"<div class=(?:ad|menu|comments)>.*?</div>", "\n", page, flags=re.DOTALL)
    page = re.sub(r"</?(?:p|h1|h2|li|ul|div|body|html|head|section)\b[^>]*>", "\x00", page.replace("<br>", " "))
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in page.split("\x00")]
    return [b for b in blocks if b]


def test_pages_without_article_against_a_second_way():
    import random

    random_ = random.Random(4)
    for _ in range(200):
        blocks = []
        for n in range(random_.randrange(2, 12)):
            size = random_.choice([1, 2, 40, 90, 200])
            text = " ".join(random_.choice(["word", "caf&eacute;", "<b>bold</b>", "a<br>b", "<a href=x>link</a> and so on"]) for _ in range(size))
            blocks.append(random_.choice(["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<section><p>{}</p></section>"]).format(f"n{n} {text}"))
        blocks.append(f"<p>{WORDS * 3}</p>")
        clutter = ["<nav><a href=x>Home</a></nav>", "<div class=ad>Buy!</div>", "<aside><p>More</p></aside>", f"<div class=comments>{WORDS}</div>", "<footer>us</footer>"]
        for c in clutter:
            blocks.insert(random_.randrange(len(blocks) + 1), c)
        page = "<html><head><title>T</title></head><body>" + "".join(blocks) + "</body></html>"
        assert html_text.main_text(page).split("\n") == plain_lines(page)
