"""Text and document jobs, on the driver's documents and pages and on documents made from its tables."""

import datetime as dt

from pyspark.sql import functions as F

from postlake.functions.text import DROPPED_BLOCKS
from postlake.operators import classify, facts, links, normalize
from postlake.plans.queries import register, view
from postlake.schemas import sources_table
from postlake.sources import api, feeds, listings, pages

NOW = dt.datetime(2026, 8, 2, 12)
FEED, ORNL, EMBL = "imechanica-job-channel", "ornl-postdoctoral-jobs", "embl-postdoctoral-jobs"
KEY = "lpad(CAST(o_orderkey AS VARCHAR), 12, '0')"
BLANK = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# --- text ------------------------------------------------------------------------------------


def entities_sql(c: str) -> str:
    """One decoding pass in SQL."""
    named = {"apos": "''", "gt": ">", "hellip": "…", "ldquo": "“", "lsquo": "‘", "lt": "<", "nbsp": " ", "quot": '"', "rdquo": "”", "rsquo": "’"}
    out = c
    for name, text in named.items():
        out = f"regexp_replace({out}, '&{name};', '{text}', 'gi')"
    return f"regexp_replace({out}, '&amp;', '&', 'gi')"


def text_sql(c: str) -> str:
    out = entities_sql(c)
    out = f"regexp_replace({out}, '<!--.*?-->', ' ', 'gs')"
    for tag in DROPPED_BLOCKS:
        out = f"regexp_replace({out}, '<{tag}[^>]*>.*?</{tag}{BLANK}*>', ' ', 'gis')"
    out = entities_sql(f"regexp_replace({out}, '<[^>]+>', ' ', 'g')")
    out = f"regexp_replace({out}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g')"
    return f"trim(regexp_replace({out}, '{BLANK}+', ' ', 'g'))"


@register("page_text", oracle=f"SELECT page_id, {text_sql('html')} AS text FROM pages")
def _page_text(spark, d):
    return links.page_text(view(spark, d, "pages", spread=True)).select("page_id", "text")


@register(
    "text_share",
    oracle=f"""SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars_in,
      CAST(sum(length({text_sql('html')})) AS BIGINT) AS chars_kept, round(sum(length({text_sql('html')})) / sum(length(html)), 6) AS kept_share FROM pages GROUP BY 1""",
)
def _share(spark, d):
    rows = links.page_text(view(spark, d, "pages", spread=True)).withColumn("host", F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    return links.text_share(rows, "host")


@register(
    "content_fingerprint",
    oracle="SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def _fingerprint(spark, d):
    return normalize.duplicate_groups(view(spark, d, "documents"), F.col("doc_id"), F.sha2("text", 256))


TERMS, OUT, INFO = ("with", "pour", "und", "para"), ("der", "la"), ("est", "los")
WORD = "\\b(?:{})\\b"


def found(c, words):
    return f"regexp_matches({c}, '(?i){WORD.format('|'.join(words))}')"


@register(
    "classify_postings", "entries",
    oracle=f"""WITH e AS (SELECT doc_id, coalesce(title, '') AS title, {text_sql('description_html')} AS body FROM entries_v),
      r AS (SELECT *, regexp_replace(concat(title, ' ', body), '(?i)\\b(?:no|not|without)\\s+(?:a\\s+)?(?:{'|'.join(TERMS)})\\b', ' ', 'g') AS rest FROM e)
      SELECT doc_id, CASE WHEN NOT {found('title', TERMS)} AND NOT {found('body', TERMS)} THEN 'no_term' WHEN {found('title', INFO)} THEN 'informational'
        WHEN NOT {found('rest', TERMS)} THEN 'negated' WHEN {found('title', OUT)} AND NOT {found('title', TERMS)} THEN 'excluded' ELSE 'accepted' END AS reason,
        len(list_distinct(list_transform(regexp_extract_all(concat(title, ' ', body), '(?i){WORD.format('|'.join(TERMS))}'), lambda x: lower(x)))) AS n_terms FROM r""",
)
def _classify(spark, d):
    rows = classify.classify_postings(view(spark, d, "entries", spread=True), terms=TERMS, excluded=OUT, informational=INFO)
    return rows.select("doc_id", "reason", F.size("matched_terms").cast("long").alias("n_terms"))


@register(
    "validate_postings", "postings",
    oracle="""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'deadline' ELSE 'ok' END AS kind, concat_ws('|', CASE WHEN o_orderkey % 6 = 0 THEN 'institution is required' END,
        'content_hash is required', CASE WHEN o_orderkey % 10 = 0 THEN 'apply_url must be HTTP or HTTPS' END, CASE WHEN is_demo THEN 'collected record markers are invalid' END,
        CASE WHEN o_orderkey % 9 = 0 THEN 'source_type is invalid' END) AS errors, count(*) AS n FROM postings_v GROUP BY ALL""",
)
def _validate(spark, d):
    key = F.col("o_orderkey")
    rows = view(spark, d, "postings", spread=True).withColumns(
        {
            "institution": F.when(key % 6 == 0, "  ").otherwise(F.col("institution")),
            "apply_url": F.when(key % 10 == 0, "mailto:a@b.c").otherwise(F.col("apply_url")),
            "source_type": F.when(key % 9 == 0, "api").otherwise(F.col("source_type")),
            "kind": F.when(key % 4 == 0, "deadline").otherwise("ok"),
        }
    )
    checked = classify.validate_postings(rows)
    return checked.groupBy("kind", F.array_join("errors", "|").alias("errors")).agg(F.count("*").alias("n"))


# --- addresses -------------------------------------------------------------------------------

CANON_SQL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(url, '#', 1), '([?&])(?:utm_[^=&]*|ref|source|fbclid|gclid|mc_cid|mc_eid)=[^&]*', '\\1', 'g'),
  '&+', '&', 'g'), '[?&]+$', ''), '/+(\\?|$)', '\\1')"""


@register("canonical_links", oracle=f"SELECT page_id, replace({CANON_SQL}, '?&', '?') AS canonical_url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def _canonical(spark, d):
    return links.canonical_links(view(spark, d, "pages")).select("page_id", "canonical_url", "host")


@register(
    "same_address_groups",
    oracle=f"""WITH c AS (SELECT url, regexp_replace(replace({CANON_SQL}, '?&', '?'), '\\?.*$', '') AS canonical_url FROM pages)
      SELECT canonical_url, count(DISTINCT url) AS forms, count(*) AS links, min(url) AS first_form FROM c GROUP BY 1 HAVING count(DISTINCT url) > 1""",
)
def _groups(spark, d):
    rows = links.canonical_links(view(spark, d, "pages"))
    return links.same_address_groups(rows.withColumn("canonical_url", F.split("canonical_url", r"\?")[0]))


@register(
    "approved_links",
    oracle="""WITH p AS (SELECT *, split_part(regexp_replace(url, '^https?://[^/?#]+', ''), '#', 1) AS rest FROM pages),
      q AS (SELECT *, split_part(rest, '?', 1) AS path, regexp_replace(regexp_replace(CASE WHEN contains(rest, '?') THEN split_part(rest, '?', 2) ELSE '' END, '(?:^|&)(?:utm_[^=&]*|ref|source)=[^&]*', '', 'g'), '^&', '') AS query FROM p),
      k AS (SELECT *, CASE WHEN url NOT LIKE 'https:%' THEN 'not secure' WHEN NOT contains(url, 'example.org') THEN 'host not approved'
        WHEN regexp_matches(path, '^/[a-z]+/\\d+/?$') AND query = '' THEN NULL ELSE 'path not approved' END AS reject_reason FROM q)
      SELECT page_id, CASE WHEN reject_reason IS NULL THEN 'detail' END AS kind, reject_reason FROM k""",
)
def _approved(spark, d):
    rows = view(spark, d, "pages").withColumn("source_key", F.lit("pages"))
    hosts = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    near = rows.where(F.col("url").contains("example.org")).select("source_key", hosts.alias("host"))
    source = spark.range(1).select(
        F.lit("pages").alias("source_key"), F.lit("/list").alias("listing_path"), F.array(F.lit(r"^/[a-z]+/\d+/?$")).alias("detail_patterns")
    )
    return links.approved_links(rows, source, hosts=near).select("page_id", "kind", "reject_reason")


@register(
    "robots_decision",
    oracle="""WITH p AS (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, split_part(regexp_replace(url, '^https?://[^/?#]+', ''), '#', 1) AS rest FROM pages)
      SELECT page_id, CASE WHEN starts_with(rest, '/fr/8') THEN TRUE WHEN starts_with(rest, '/fr/') THEN FALSE WHEN regexp_matches(rest, '^/.*\\.html$') THEN FALSE ELSE TRUE END AS allowed,
        CASE WHEN starts_with(rest, '/fr/8') THEN '/fr/8' WHEN regexp_matches(rest, '^/.*\\.html$') THEN '/*.html$' WHEN starts_with(rest, '/fr/') THEN '/fr/' END AS rule,
        CAST(length(host) AS DOUBLE) AS crawl_delay FROM p""",
)
def _robots(spark, d):
    rows = view(spark, d, "pages")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    files = rows.select(host.alias("host")).distinct().select(
        "host",
        F.concat(
            F.lit("User-agent: *\nDisallow: /fr/ # no\nAllow: /fr/8\nDisallow: /*.html$\nCrawl-delay: "), F.length("host").cast("string"),
            F.lit("\nUser-agent: OtherBot\nDisallow: /\n"),
        ).alias("text"),
        F.lit(None).cast("string").alias("content_signal"),
    )
    return links.robots_decision(rows.select("page_id", "url"), files, "SomeBot").select("page_id", "allowed", "rule", "crawl_delay")


@register(
    "page_anchors",
    oracle="""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
        unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) AS pos FROM pages)
      SELECT page_id, CAST(pos AS INT) AS pos, href, text, text AS parent_text, TRUE AS excluded FROM a""",
)
def _anchors(spark, d):
    # The whole html; without the article's own tags the document is one content, menus included.
    whole = view(spark, d, "pages").select("page_id", F.regexp_replace("html", "</?article>", "").alias("html"))
    return pages.page_anchors(whole).select("page_id", "pos", "href", "text", "parent_text", "excluded")


# --- documents made from the tables ----------------------------------------------------------



def _pages_of(spark, d):
    """A page per posting: odd keys carry structured data, multiples of three an application link."""
    p = view(spark, d, "postings", spread=True)
    key = F.col("o_orderkey")
    posting = F.to_json(
        F.struct(
            F.lit("JobPosting").alias("@type"), F.concat(F.lit("Postdoc "), "title").alias("title"), F.col("description"),
            F.col("posted_at").cast("string").alias("datePosted"), F.col("deadline").cast("string").alias("validThrough"),
            F.struct(F.col("institution").alias("name")).alias("hiringOrganization"),
            F.struct(F.struct(F.col("city").alias("addressLocality"), F.col("country").alias("addressCountry")).alias("address")).alias("jobLocation"),
            F.col("employment_type").alias("employmentType"),
        )
    )
    graph = F.concat(F.lit('{"@graph":[{"@type":"Organization"},'), posting, F.lit("]}"))
    script = F.when(
        key % 2 == 1, F.concat(F.lit('<script type="application/ld+json">'), F.when(key % 4 == 1, graph).otherwise(posting), F.lit("</script>"))
    ).otherwise("")
    apply = F.when(
        key % 3 == 0, F.concat(F.lit('<p><a href="https://careers.example.org/jobs/'), "id", F.lit('?utm_source=x">Apply now</a></p>'))
    ).otherwise("")
    html = F.concat(
        F.lit('<html lang="en-US"><head>'), script, F.lit("</head><body><article><h1>Postdoc "), "title", F.lit('</h1><time datetime="'),
        F.col("posted_at").cast("string"), F.lit('"></time><p>Postdoc work at '), "institution", F.lit('.</p><p><a href="/about">Group home</a></p>'), apply,
        F.lit("</article></body></html>"),
    )
    return p.select(
        F.col("id").alias("page_id"), "o_orderkey", F.lit(FEED).alias("source_key"), F.concat(F.lit("https://imechanica.org/node/"), key.cast("string")).alias("url"),
        html.alias("html"), F.lit("https://imechanica.org/taxonomy/term/73").alias("listing_url"),
    )


@register(
    "jsonld_postings", "postings",
    oracle="""SELECT id AS page_id, concat('Postdoc ', title) AS title, description, CAST(posted_at AS VARCHAR) AS date_posted, coalesce(CAST(deadline AS VARCHAR), '') AS deadline,
      institution, city, country, coalesce(employment_type, '') AS employment_type FROM postings_v WHERE o_orderkey % 2 = 1""",
)
def _jsonld(spark, d):
    return pages.jsonld_postings(_pages_of(spark, d)).select(
        "page_id", "title", "description", "date_posted", "deadline", "institution", "city", "country", "employment_type"
    )


LINK_SQL = "CASE WHEN o_orderkey % 3 = 0 THEN concat('https://careers.example.org/jobs/', id) ELSE concat('https://imechanica.org/node/', CAST(o_orderkey AS VARCHAR)) END"


@register(
    "application_link", "postings",
    oracle=f"SELECT id AS page_id, {LINK_SQL} AS apply_url, CASE WHEN o_orderkey % 3 = 0 THEN 'explicit_apply_link' ELSE 'source_detail_fallback' END AS reason, CASE WHEN o_orderkey % 3 = 0 THEN 395 END AS score FROM postings_v",
)
def _application(spark, d):
    rows = _pages_of(spark, d)
    return pages.application_link(pages.page_anchors(rows), rows)


@register(
    "page_entries", "postings",
    oracle=f"""SELECT id AS page_id, concat('Postdoc ', title) AS title, CAST(posted_at AS VARCHAR) AS pub_date, {LINK_SQL} AS apply_url, CASE WHEN o_orderkey % 2 = 1 THEN description
        ELSE concat('Postdoc ', title, ' Postdoc work at ', institution, '. Group home', CASE WHEN o_orderkey % 3 = 0 THEN ' Apply now' ELSE '' END) END AS description_html,
      CASE WHEN o_orderkey % 2 = 1 THEN institution ELSE '' END AS institution
      FROM (SELECT * REPLACE (concat('Order of ', institution, ' in ', country) AS description) FROM postings_v)""",
)
def _page_entries(spark, d):
    # Structured postings must be in scope, so their description names the term.
    rows = pages.page_entries(_pages_of(spark, d))
    return rows.select("page_id", "title", "pub_date", "apply_url", "description_html", "institution")


@register(
    "portal_entries", "postings",
    oracle="""SELECT id AS page_id, CAST(o_orderkey AS VARCHAR) AS source_item_id, CASE WHEN o_orderkey % 2 = 1 THEN institution ELSE 'Oak Ridge National Laboratory' END AS institution,
      'en' AS source_language, FALSE AS closed FROM postings_v""",
)
def _portal_entries(spark, d):
    rows = _pages_of(spark, d).select(
        "page_id", F.lit(ORNL).alias("source_key"), F.concat(F.lit("https://jobs.ornl.gov/job/post/"), F.col("o_orderkey").cast("string"), F.lit("/")).alias("url"),
        "html", F.lit("").alias("listing_title"),
    )
    return pages.portal_entries(rows, sources_table(spark)).select("page_id", "source_item_id", "institution", "source_language", "closed")


@register(
    "listing_links", "postings",
    oracle="""SELECT id AS page_id, 'detail' AS kind, concat('https://imechanica.org/node/', CAST(o_orderkey AS VARCHAR)) AS url, concat(title, ' A') AS title FROM postings_v
      UNION ALL SELECT id, 'detail', concat('https://imechanica.org/node/', CAST(o_orderkey + 1 AS VARCHAR)), concat(title, ' B') FROM postings_v
      UNION ALL SELECT id, 'page', concat('https://imechanica.org/taxonomy/term/73?page=', CAST(o_orderkey % 9 AS VARCHAR)), '' FROM postings_v""",
)
def _listing(spark, d):
    key = F.col("o_orderkey")
    link = lambda k, t: F.concat(F.lit('<article><h2><a href="/node/'), k.cast("string"), F.lit('">'), "title", F.lit(f" {t}</a></h2></article>"))
    html = F.concat(
        link(key, "A"), link(key + 1, "B"), link(key, "C"), F.lit('<article><h2><a href="/user/1">x</a></h2></article><ul class="pager"><li><a href="?page='),
        (key % 9).cast("string"), F.lit('">next</a></li></ul>'),
    )
    rows = view(spark, d, "postings", spread=True).select(
        F.col("id").alias("page_id"), F.lit(FEED).alias("source_key"), F.lit("https://imechanica.org/taxonomy/term/73").alias("url"), html.alias("html")
    )
    return listings.listing_links(rows, sources_table(spark)).select("page_id", "kind", "url", "title")


def _portal_pages(spark, d):
    key = F.col("o_orderkey").cast("string")
    html = F.concat(
        F.lit('<a href="/job/Post-'), key, F.lit("/"), key, F.lit('/">Postdoctoral '), "title", F.lit('</a> <a href="/about">About</a> <a href="/job/Post-'), key, F.lit("/"), key,
        F.lit('">Again</a> <a href="/go/Postdoctoral-Jobs/4537100/?startrow='), key, F.lit('">Next</a>'),
    )
    return view(spark, d, "postings", spread=True).select(
        F.col("id").alias("page_id"), F.lit(ORNL).alias("source_key"), F.lit("https://jobs.ornl.gov/go/Postdoctoral-Jobs/4537100/").alias("url"), html.alias("html")
    )


@register(
    "portal_links", "postings",
    oracle="""SELECT id AS page_id, 'detail' AS kind, concat('https://jobs.ornl.gov/job/Post-', o_orderkey, '/', o_orderkey) AS url, concat('Postdoctoral ', title) AS title FROM postings_v
      UNION ALL SELECT id, 'page', concat('https://jobs.ornl.gov/go/Postdoctoral-Jobs/4537100?startrow=', o_orderkey), 'Next' FROM postings_v""",
)
def _portal(spark, d):
    return listings.portal_links(_portal_pages(spark, d), sources_table(spark)).select("page_id", "kind", "url", "title")


@register(
    "crawl_frontier", "postings",
    oracle=f"""WITH l AS (SELECT '{ORNL}' AS source_key, concat('https://jobs.ornl.gov/job/Post-', o_orderkey, '/', o_orderkey) AS url, o_orderkey AS pos FROM postings_v)
      SELECT source_key, url, row_number() OVER (ORDER BY pos, url) AS rank FROM l QUALIFY rank <= 10""",
)
def _frontier(spark, d):
    sources = sources_table(spark)
    rows = listings.portal_links(_portal_pages(spark, d), sources).where("kind = 'detail'")
    rows = rows.withColumn("pos", F.col("page_id").cast("long"))
    return listings.crawl_frontier(rows, sources).select("source_key", "url", F.col("rank").cast("long").alias("rank"))


@register(
    "feed_items",
    oracle="""WITH t AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\r]', '', 'g'), chr(10))) AS line,
        unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
      SELECT doc_id, CAST(pos AS INT) AS pos, md5(trim(regexp_replace(line, '[\\s\\x{85}\\x{a0}]+', ' ', 'g'))) AS title_hash, concat('https://feeds.example.org/', doc_id, '/', pos) AS link, lower(CAST(doc_id AS VARCHAR)) AS guid FROM t""",
)
def _feed(spark, d):
    def escape(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    text = F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f\r]", "")
    item = lambda line, i: F.concat(
        F.lit("<item><title>"), escape(line), F.lit("</title><link>https://feeds.example.org/"), F.col("doc_id").cast("string"), F.lit("/"), i.cast("string"),
        F.lit('</link><guid isPermaLink="false">'), F.col("doc_id").cast("string"), F.lit("</guid></item>"),
    )
    xml = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(F.split(text, "\n"), item), ""), F.lit("</channel></rss>"))
    docs = view(spark, d, "documents", spread=True).select("doc_id", F.col("source").alias("source_key"), xml.alias("xml"))
    return feeds.feed_items(docs).select(
        "doc_id", "pos", F.md5(F.trim(F.regexp_replace("title", r"[\s\x{85}\x{a0}]+", " "))).alias("title_hash"), "link", "guid"
    )


def _listings_of(spark, d):
    key = F.col("o_orderkey").cast("string")
    post = lambda path, title, ident: F.struct(
        title.alias("title"), path.alias("externalPath"), F.col("city").alias("locationsText"), F.array(ident).alias("bulletFields")
    )
    title = F.concat(F.lit("Postdoc "), "title")
    rows = F.array(
        post(F.concat(F.lit("/job/"), key, F.lit("_a")), title, key),
        post(F.concat(F.lit("/job/"), key, F.lit("_b")), F.concat(title, F.lit(" again")), key),
        post(F.lit(None).cast("string"), title, F.lit("none")),
    )
    return view(spark, d, "postings", spread=True).select(
        F.col("id").alias("doc_id"), F.lit(EMBL).alias("source_key"), F.to_json(F.struct(F.lit(3).alias("total"), rows.alias("jobPostings"))).alias("json"),
        "o_orderkey", "title", "country", "posted_at", "deadline", "is_active",
    )


@register(
    "api_listings", "postings",
    oracle="SELECT id AS doc_id, CAST(o_orderkey AS VARCHAR) AS source_item_id, concat('/job/', o_orderkey, '_b') AS external_path, concat('Postdoc ', title, ' again') AS title, city AS location, 0 AS pos FROM postings_v",
)
def _api(spark, d):
    return api.api_listings(_listings_of(spark, d)).select("doc_id", "source_item_id", "external_path", "title", "location", "pos")


@register(
    "api_details", "postings",
    oracle=f"""SELECT CAST(o_orderkey AS VARCHAR) AS source_item_id, concat('Postdoc ', title, ' again') AS title, concat('https://embl.wd103.myworkdayjobs.com/EMBL/job/', o_orderkey, '_b') AS link,
      CASE WHEN o_orderkey % 2 = 0 THEN 'Rome' ELSE city END AS city, CASE WHEN o_orderkey % 2 = 0 THEN 'Italy' ELSE '' END AS country, CAST(posted_at AS VARCHAR) AS pub_date,
      coalesce(CAST(deadline AS VARCHAR), '') AS deadline, NOT is_active AS closed FROM postings_v""",
)
def _details(spark, d):
    rows = _listings_of(spark, d)
    info = F.struct(
        F.concat(F.lit("<p>Postdoc for "), "title", F.lit("</p>")).alias("jobDescription"), F.col("posted_at").cast("string").alias("startDate"),
        F.col("deadline").cast("string").alias("endDate"), F.col("is_active").alias("posted"), F.when(F.col("o_orderkey") % 2 == 0, "EMBL Rome").alias("location"),
    )
    details = rows.select(
        "source_key", F.concat(F.lit("/job/"), F.col("o_orderkey").cast("string"), F.lit("_b")).alias("external_path"), F.to_json(F.struct(info.alias("jobPostingInfo"))).alias("json")
    )
    return api.api_details(details, api.api_listings(rows), sources_table(spark)).select(
        "source_item_id", "title", "link", "city", "country", "pub_date", "deadline", "closed"
    )


AREA_SQL = "CASE o_orderkey % 4 WHEN 0 THEN 'Artificial Intelligence' WHEN 1 THEN 'Chemistry' WHEN 2 THEN 'Physics' ELSE 'Other / Multidisciplinary' END"
LAND_SQL = "CASE o_orderkey % 3 WHEN 0 THEN 'Germany' WHEN 1 THEN 'United States' ELSE 'Not specified' END"


def _fact_texts(spark, d):
    key = F.col("o_orderkey")
    topic = F.when(key % 4 == 0, "machine learning and physics").when(key % 4 == 1, "catalysis").when(key % 4 == 2, "quantum optics").otherwise("poetry")
    place = F.when(key % 3 == 0, "Location: Bonn, Germany.").when(key % 3 == 1, "Based in the USA.").otherwise("Anywhere.")
    close = F.when(F.col("deadline").isNotNull(), F.concat(F.lit("Applications close: "), F.date_format("deadline", "MMMM d, yyyy"), F.lit("."))).otherwise("")
    term = F.when(key % 5 == 0, "Duration: two years.").when(key % 5 == 1, "The appointment is 18 months.").otherwise("")
    text = F.concat_ws(" ", F.lit("A postdoc at the"), F.concat(F.regexp_replace("institution", "#", ""), F.lit(" Institute")), F.concat(F.lit("in "), topic, F.lit(".")), place, close, term)
    return view(spark, d, "postings", spread=True).select(
        "id", "o_orderkey", "source_key", text.alias("text"), F.array(F.lit("Topic"), F.lit("topic")).alias("categories"), F.lit("").alias("apply_host"), "posted_at"
    )


@register(
    "posting_facts", "postings",
    oracle=f"""SELECT id, CAST(deadline AS VARCHAR) AS deadline, CASE o_orderkey % 5 WHEN 0 THEN '2 years' WHEN 1 THEN '18 months' ELSE '' END AS duration,
      {AREA_SQL} AS research_area, {LAND_SQL} AS country, CASE WHEN o_orderkey % 3 = 0 THEN 'Bonn' ELSE '' END AS city,
      concat('Topic|', {AREA_SQL}, '|Postdoctoral', CASE WHEN o_orderkey % 4 = 0 THEN '|Physics' ELSE '' END) AS tags FROM postings_v""",
)
def _facts(spark, d):
    return facts.posting_facts(_fact_texts(spark, d)).select("id", "deadline", "duration", "research_area", "country", "city", "tags")


@register(
    "fill_rates", "postings",
    oracle="""SELECT source_key, count(*) AS n, round(avg(CAST(deadline IS NOT NULL AS INT)), 6) AS deadline_rate, round(avg(CAST(o_orderkey % 5 <= 1 AS INT)), 6) AS duration_rate,
      round(avg(CAST(o_orderkey % 3 < 2 AS INT)), 6) AS country_rate, round(avg(CAST(o_orderkey % 3 = 0 AS INT)), 6) AS city_rate, round(avg(CAST(o_orderkey % 4 < 3 AS INT)), 6) AS research_area_rate FROM postings_v GROUP BY 1""",
)
def _rates(spark, d):
    return facts.fill_rates(facts.posting_facts(_fact_texts(spark, d))).drop("institution_rate")


def _entries_of(spark, d):
    rows = _fact_texts(spark, d)
    none = F.lit("")
    return rows.select(
        F.lit(FEED).alias("source_key"), F.concat(F.lit("iMechanica: Postdoc "), "id").alias("title"),
        F.concat(F.lit("<p>"), "text", F.lit('</p><p><a href="https://careers.example.edu/jobs/'), "id", F.lit('?utm_source=f">Apply now</a></p>')).alias("description_html"),
        F.concat(F.lit("https://www.imechanica.org/node/"), F.col("o_orderkey").cast("string"), F.lit("/?ref=f")).alias("link"),
        none.alias("guid"), F.lit(None).cast("string").alias("source_item_id"), F.col("posted_at").cast("string").alias("pub_date"), "categories",
        none.alias("institution"), none.alias("country"), none.alias("city"), none.alias("deadline"), none.alias("duration"), none.alias("employment_type"),
        F.lit(None).cast("string").alias("apply_url"), F.lit(None).cast("string").alias("source_language"), F.lit("rss").alias("source_type"), F.lit(False).alias("closed"),
    )


@register(
    "normalize_postings", "postings",
    oracle=f"""WITH n AS (SELECT *, concat('https://imechanica.org/node/', o_orderkey) AS u FROM postings_v)
      SELECT concat('collected-', substr(sha256(concat('{FEED}', chr(10), u)), 1, 32)) AS id, concat('Postdoc ', id) AS title, u AS source_url,
      concat('https://careers.example.edu/jobs/', id) AS apply_url, {LAND_SQL} AS country, {AREA_SQL} AS research_area, CAST(posted_at AS VARCHAR) AS posted_at,
      CAST(deadline AS VARCHAR) AS deadline, 'rss' AS source_type FROM n""",
)
def _normalize(spark, d):
    return normalize.normalize_postings(_entries_of(spark, d), sources_table(spark), NOW).select(
        "id", "title", "source_url", "apply_url", "country", "research_area", "posted_at", "deadline", "source_type"
    )
