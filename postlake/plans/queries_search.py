"""Search, presentation, scoring, lifecycle."""

from pyspark.sql import functions as F

from postlake.operators import lifecycle, present, score, search, search_tables, selection
from postlake.operators.accounting import sources_per_job, status_counts
from postlake.plans.queries import AS_OF, AS_OF_TS, register, view
from postlake.session import scratch_path
from postlake.sources import tables

DAY = f"DATE '{AS_OF}'"
NOW = f"TIMESTAMP '{AS_OF_TS}'"
NOT_PAST = f"(deadline IS NULL OR deadline >= {DAY})"
PUBLIC = f"""
  collection_state = 'active' AND CASE WHEN EXISTS (
      SELECT 1 FROM postings_v WHERE is_active AND origin_type = 'collected' AND NOT is_demo
        AND collection_state = 'active' AND {NOT_PAST})
    THEN origin_type = 'collected' AND NOT is_demo ELSE origin_type = 'seed' AND is_demo END"""


def has(word: str) -> str:
    cols = [f"lower(coalesce({c}, ''))" for c in ("title", "institution", "country", "city", "research_area", "language", "description")]
    cols.append("lower(to_json(tags))")
    return "(" + " OR ".join(f"contains({c}, '{word}')" for c in cols) + ")"


PAGE_SQL = """
WITH page AS (SELECT *, row_number() OVER (ORDER BY posted_at DESC, created_at DESC, id DESC) - 1 - {offset} AS place FROM postings_v WHERE is_active AND {where}
  ORDER BY posted_at DESC, created_at DESC, id DESC LIMIT {limit} OFFSET {offset}),
counts AS (SELECT job_id, count(*) AS n FROM observations_v WHERE observation_state = 'active' GROUP BY job_id)
SELECT p.id, p.title, p.institution, p.country, p.city, p.research_area, p.language, p.source_language,
  p.source_name, coalesce(s.institution_owned, FALSE) AS official_source, coalesce(c.n, 0) AS source_count,
  strftime(p.last_verified_at, '%Y-%m-%d %H:%M:%S') AS last_verified_at, p.description, p.apply_url, p.source_url,
  CAST(p.deadline AS VARCHAR) AS deadline, CAST(p.posted_at AS VARCHAR) AS posted_at,
  strftime(p.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(p.updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at,
  p.employment_type, p.duration, array_to_string(p.tags, '|') AS tags, p.is_demo, p.place
FROM page p LEFT JOIN source_dim_v s ON s.source_key = p.source_key LEFT JOIN counts c ON c.job_id = p.id"""


def _page(filters, limit, offset=0):
    def run(spark, d):
        page = search.search_page(view(spark, d, "postings"), filters, AS_OF, limit, offset)
        shown = present.page_view(page, view(spark, d, "source_dim"), view(spark, d, "observations"))
        # a page has one partition, so this numbers its rows as they come
        return shown.withColumn("place", F.monotonically_increasing_id())

    return run


WINDOW_60 = f"deadline BETWEEN {DAY} AND {DAY} + 60"
V = ("postings", "observations", "source_dim")
register("search_page_live", *V, oracle=PAGE_SQL.format(where=PUBLIC + f" AND {NOT_PAST}", limit=50, offset=0))(_page({}, 50))
register(
    "search_page_keyword", *V,
    oracle=PAGE_SQL.format(
        where=f"{PUBLIC} AND {NOT_PAST} AND {has('nation_1')} AND lower(research_area) = 'furniture'", limit=20, offset=20
    ),
)(_page({"keyword": " Nation_1", "research_area": "Furniture "}, 20, 20))
register(
    "search_page_deadline", *V,
    oracle=PAGE_SQL.format(where=f"{PUBLIC} AND {NOT_PAST} AND contains(lower(language), 'english') AND {WINDOW_60}", limit=100, offset=0),
)(_page({"language": "english", "deadline": "60"}, 100))


@register(
    "search_after", "postings",
    oracle=f"""SELECT id, title, CAST(posted_at AS VARCHAR) AS posted_at, row_number() OVER (ORDER BY posted_at DESC, created_at DESC, id DESC) - 41 AS place
      FROM postings_v WHERE is_active AND {PUBLIC} AND {NOT_PAST} AND lower(research_area) = 'furniture' AND contains(lower(language), 'english')
      ORDER BY posted_at DESC, created_at DESC, id DESC LIMIT 20 OFFSET 40""",
)
def _after(spark, d):
    """The third page, each page found from the last row of the one before."""
    path = scratch_path(spark, "search")
    search.write_search_table(view(spark, d, "postings"), path)
    table, last = spark.read.parquet(path), None
    for _ in range(3):
        page = search.search_after(table, {"research_area": " Furniture", "language": "English"}, AS_OF, last, 20)
        shown = page.select("posted_at", "created_at", "id").collect()
        if not shown:
            break
        last = tuple(shown[-1])
    return page.select("id", "title", "posted_at").withColumn("place", F.monotonically_increasing_id())


@register(
    "search_total", "postings",
    oracle=f"""SELECT count(*) AS total, least(greatest(count(*) - 20, 0), 20) AS shown,
      20 + least(greatest(count(*) - 20, 0), 20) < count(*) AS has_more
      FROM postings_v WHERE is_active AND {PUBLIC} AND {NOT_PAST} AND {has('nation_1')} AND deadline IS NOT NULL""",
)
def _total(spark, d):
    return search.search_total(view(spark, d, "postings"), {"q": "NATION_1", "deadline": "open"}, AS_OF, 20, 20)


MANY = {
    "a": ({"country": "NATION_3"}, "lower(country) = 'nation_3'"),
    "b": ({"keyword": "machinery", "deadline": "none"}, f"{has('machinery')} AND deadline IS NULL"),
    "c": ({"language": "french", "deadline": "30"}, f"contains(lower(language), 'french') AND deadline BETWEEN {DAY} AND {DAY} + 30"),
    "d": ({"keyword": "no such word"}, "FALSE"),
    "e": ({"keyword": '","'}, """contains(lower(to_json(tags)), '","')"""),
}


@register(
    "search_many", "postings",
    oracle=" UNION ALL ".join(
        f"SELECT '{k}' AS request_id, count(*) AS matching_jobs FROM postings_v WHERE is_active AND {PUBLIC} AND {NOT_PAST} AND {sql}"
        for k, (_, sql) in MANY.items()
    ),
)
def _many(spark, d):
    return search.search_many(view(spark, d, "postings"), {k: f for k, (f, _) in MANY.items()}, AS_OF)


WORDS = ("title", "institution", "country", "city", "research_area", "language", "description")
HOLDS = " OR ".join([*(f"contains(lower(coalesce(p.{c}, '')), a.k)" for c in WORDS), "contains(lower(to_json(p.tags)), a.k)"])


@register(
    "search_requests", "postings", "searches",
    oracle=f"""WITH n AS (SELECT request_id, lower(trim(keyword)) AS k, lower(trim(country)) AS c, lower(trim(research_area)) AS r, lower(trim(language)) AS l, deadline AS d FROM searches_v),
      a AS (SELECT DISTINCT k, c, r, l, d FROM n), live AS MATERIALIZED (SELECT * FROM postings_v WHERE is_active AND {PUBLIC} AND {NOT_PAST}),
      f AS (SELECT a.*, count(*) AS matching FROM a JOIN live p ON (a.k = '' OR {HOLDS}) AND (a.c = '' OR lower(trim(p.country)) = a.c)
        AND (a.r = '' OR lower(trim(p.research_area)) = a.r) AND (a.l = '' OR contains(lower(p.language), a.l))
        AND CASE a.d WHEN 'open' THEN p.deadline IS NOT NULL WHEN 'none' THEN p.deadline IS NULL WHEN 'other' THEN TRUE ELSE p.deadline BETWEEN {DAY} AND {DAY} + CAST(a.d AS INT) END
        GROUP BY ALL)
      SELECT request_id, coalesce(matching, 0) AS matching_jobs FROM n LEFT JOIN f USING (k, c, r, l, d)""",
)
def _search_requests(spark, d):
    return search_tables.search_requests(view(spark, d, "postings"), view(spark, d, "searches"), AS_OF)


@register(
    "search_memory", "postings",
    oracle=f"""SELECT research_area, count(*) AS n FROM postings_v
      WHERE {NOT_PAST} AND contains(concat_ws(' ', lower(title), lower(institution), lower(country), lower(city),
        lower(research_area), lower(description), lower(array_to_string(tags, ' '))), 'nation_10 city')
        AND lower(language) = 'english' GROUP BY research_area""",
)
def _memory(spark, d):
    rows = search.search_filter(view(spark, d, "postings"), {"keyword": "Nation_10 City", "language": "English"}, AS_OF, "memory")
    return rows.groupBy("research_area").agg(F.count("*").alias("n"))


@register("public_dataset", "postings", oracle=f"SELECT origin_type, count(*) AS n FROM postings_v WHERE {PUBLIC} GROUP BY origin_type")
def _public(spark, d):
    return search.public_dataset(view(spark, d, "postings"), AS_OF).groupBy("origin_type").agg(F.count("*").alias("n"))


@register(
    "source_language_filter", "postings",
    oracle="SELECT source_key, count(*) AS n FROM postings_v WHERE source_language = 'fr' AND NOT is_demo GROUP BY source_key",
)
def _language(spark, d):
    rows = search.live_only(search.source_language_filter(view(spark, d, "postings"), "French"))
    return rows.groupBy("source_key").agg(F.count("*").alias("n"))


@register(
    "facet_values", "postings",
    oracle="""SELECT field, value, count(*) AS n FROM (
      SELECT 'country' AS field, country AS value FROM postings_v UNION ALL SELECT 'research_area', research_area FROM postings_v
      UNION ALL SELECT 'language', language FROM postings_v) t WHERE value <> '' GROUP BY field, value""",
)
def _facets(spark, d):
    return search.facet_values(view(spark, d, "postings"))


@register(
    "source_language_facets", "postings",
    oracle="""SELECT source_language AS value, count(*) AS n,
      CASE source_language WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'Spanish' END AS label
      FROM postings_v GROUP BY source_language""",
)
def _language_facets(spark, d):
    return search.source_language_facets(view(spark, d, "postings"))


@register("sources_per_job", "observations", oracle="SELECT job_id, count(*) AS n FROM observations_v GROUP BY job_id")
def _per_job(spark, d):
    return sources_per_job(view(spark, d, "observations"))


@register("status_counts", "postings", oracle="SELECT collection_state, count(*) AS n FROM postings_v GROUP BY collection_state")
def _status(spark, d):
    return status_counts(view(spark, d, "postings"), "collection_state")


@register(
    "source_count", "observations",
    oracle="SELECT job_id, count(*) AS source_count FROM observations_v WHERE observation_state = 'active' GROUP BY job_id",
)
def _counts(spark, d):
    return present.source_counts(view(spark, d, "observations"))


@register(
    "enrich_source", "postings", "source_dim",
    oracle="""SELECT s.institution_owned AS official_source, p.source_name, count(*) AS n FROM postings_v p
      LEFT JOIN source_dim_v s ON s.source_key = p.source_key GROUP BY ALL""",
)
def _enrich(spark, d):
    rows = present.public_view(view(spark, d, "postings"), view(spark, d, "source_dim"))
    return rows.groupBy("official_source", "source_name").agg(F.count("*").alias("n"))


@register(
    "presentation_flags", "postings",
    oracle=f"""SELECT id, concat(city, ', ', country, ' · ', language) AS location_label,
      CASE source_language WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'Spanish' END AS language_label,
      coalesce(deadline < {DAY}, FALSE) AS is_expired, coalesce(deadline BETWEEN {DAY} AND {DAY} + 7, FALSE) AS closing_soon,
      apply_url <> source_url AS direct_application,
      coalesce(strftime(deadline, '%b %-d, %Y'), 'No stated deadline') AS deadline_label FROM postings_v""",
)
def _flags(spark, d):
    return present.presentation_flags(view(spark, d, "postings"), AS_OF).select(
        "id", "location_label", "language_label", "is_expired", "closing_soon", "direct_application", "deadline_label"
    )


@register(
    "jobs_list", "postings",
    oracle="SELECT id, title, country, CAST(deadline AS VARCHAR) AS deadline, is_demo FROM postings_v",
)
def _list(spark, d):
    return tables.jobs_list(view(spark, d, "postings"))


STATE_SQL = f"""CASE WHEN deadline < {DAY} THEN 'expired'
  WHEN last_seen_at <= {NOW} - INTERVAL 75 DAYS THEN 'expired' WHEN last_seen_at <= {NOW} - INTERVAL 45 DAYS THEN 'stale' ELSE 'active' END"""


@register("lifecycle_state", "postings", oracle=f"SELECT id, {STATE_SQL} AS state FROM postings_v")
def _state(spark, d):
    return lifecycle.lifecycle_state(view(spark, d, "postings"), AS_OF_TS).select("id", "state")


AGED = f"""aged AS (SELECT *, CASE WHEN origin_type <> 'collected' OR is_demo OR collection_state = 'expired' THEN NULL
  WHEN deadline < {DAY} THEN 'past_deadline' WHEN last_seen_at <= {NOW} - INTERVAL 75 DAYS THEN 'unseen_75_days'
  WHEN collection_state = 'active' AND last_seen_at <= {NOW} - INTERVAL 45 DAYS THEN 'unseen_45_days' END AS why FROM postings_v),
 moved AS (SELECT *, CASE WHEN why = 'unseen_45_days' THEN 'stale' WHEN why IS NOT NULL THEN 'expired' ELSE collection_state END AS new_state FROM aged)"""


@register(
    "expire_postings", "postings",
    oracle=f"WITH {AGED} SELECT id, new_state AS collection_state, coalesce(why, expiry_reason) AS expiry_reason FROM moved",
)
def _expire(spark, d):
    return lifecycle.expire_postings(view(spark, d, "postings"), AS_OF_TS).select("id", "collection_state", "expiry_reason")


@register(
    "lifecycle_counts", "postings",
    oracle=f"WITH {AGED} SELECT count(*) FILTER (why IS NOT NULL AND new_state = 'expired') AS expired, count(*) FILTER (new_state = 'stale' AND why IS NOT NULL) AS stale FROM moved",
)
def _life_counts(spark, d):
    return lifecycle.lifecycle_counts(lifecycle.expire_postings(view(spark, d, "postings"), AS_OF_TS))


@register(
    "expire_observations", "postings", "observations",
    oracle=f"""WITH {AGED}, s AS (SELECT id, new_state FROM moved WHERE origin_type = 'collected' AND NOT is_demo)
      SELECT o.source_key, CASE WHEN s.new_state = 'expired' THEN 'expired' WHEN s.new_state = 'stale' AND o.observation_state = 'active'
        THEN 'stale' ELSE o.observation_state END AS observation_state, count(*) AS n
      FROM observations_v o LEFT JOIN s ON s.id = o.job_id GROUP BY 1, 2""",
)
def _expire_observations(spark, d):
    aged = lifecycle.expire_postings(view(spark, d, "postings"), AS_OF_TS)
    rows = lifecycle.expire_observations(view(spark, d, "observations"), aged, AS_OF_TS)
    return rows.groupBy("source_key", "observation_state").agg(F.count("*").alias("n"))


@register(
    "close_observations", "postings", "observations",
    oracle="""WITH o AS (SELECT *, l_returnflag = 'R' AS closed, l_linenumber = 1 AS is_primary,
        row_number() OVER () AS rid FROM observations_v),
      keys AS (SELECT DISTINCT source_key, source_item_id FROM o WHERE closed),
      m AS (SELECT o.job_id, o.is_primary, k.source_key IS NOT NULL AS closed,
          CASE WHEN k.source_key IS NOT NULL THEN 'expired' ELSE o.observation_state END AS st
        FROM o LEFT JOIN keys k ON k.source_key = o.source_key AND k.source_item_id = o.source_item_id),
      j AS (SELECT job_id, bool_or(closed AND is_primary) AS prim, bool_or(closed) AS any_closed, bool_or(st = 'active') AS open_left FROM m GROUP BY job_id),
      r AS (SELECT p.id, CASE WHEN NOT coalesce(j.any_closed, FALSE) OR p.origin_type <> 'collected' OR p.is_demo THEN NULL
          WHEN j.prim THEN 'primary_source_closed' WHEN NOT j.open_left THEN 'all_sources_inactive' END AS why,
          p.collection_state, p.is_active, p.expiry_reason FROM postings_v p LEFT JOIN j ON j.job_id = p.id)
      SELECT id, CASE WHEN why IS NULL THEN collection_state ELSE 'expired' END AS collection_state,
        is_active AND why IS NULL AS is_active, coalesce(why, expiry_reason) AS expiry_reason FROM r""",
)
def _close(spark, d):
    observations = view(spark, d, "observations").withColumn("is_primary", F.col("l_linenumber") == 1)
    closed = observations.where(F.col("l_returnflag") == "R")
    _, jobs = lifecycle.close_observations(observations, view(spark, d, "postings"), closed, AS_OF_TS)
    return jobs.select("id", "collection_state", "is_active", "expiry_reason")


# --- scoring and comparison ------------------------------------------------------------------

SCORE_SQL = f"""
WITH t AS (
  SELECT s.profile_id, p.id, regexp_extract_all(lower(pr.research_keywords), '[a-z0-9]{{2,}}') AS tokens,
    lower(concat_ws(' ', p.title, p.research_area, p.description, array_to_string(p.tags, ' '))) AS raw,
    pr.countries, pr.source_languages, pr.deadline AS wish, pr.minimum_duration_months AS mm,
    pr.require_direct_application AS wd, pr.prefer_official_source AS wo, p.country, p.city, p.source_language, p.deadline,
    p.apply_url <> p.source_url AS direct, coalesce(sd.institution_owned, FALSE) AS official, p.employment_type,
    CASE p.duration WHEN '2 years' THEN 24 WHEN '18 months' THEN 18 END AS months
  FROM shown_v s JOIN profiles_v pr ON pr.profile_id = s.profile_id JOIN postings_v p ON p.id = s.id
  LEFT JOIN source_dim_v sd ON sd.source_key = p.source_key),
u AS (SELECT *, list_filter(tokens, lambda tok: contains(trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')), tok)) AS hit,
    countries <> '' AS hc, source_languages <> '' AS hl,
    countries <> '' AND (lower(country) = lower(split(countries, ';')[1]) OR country = 'NATION_1') AS ch,
    source_languages <> '' AND source_language IN ('en', 'de') AS lh, deadline - {DAY} AS days FROM t),
w AS (SELECT *, CASE WHEN hc AND hl THEN 12 WHEN hc THEN 20 ELSE 0 END AS cm, CASE WHEN hc AND hl THEN 8 WHEN hl THEN 20 ELSE 0 END AS lm,
    CASE WHEN wish <> '' AND days >= 0 AND (wish = 'open' OR days <= CAST(CASE WHEN wish = 'open' THEN '0' ELSE wish END AS INT)) THEN 15 ELSE 0 END AS dp,
    CASE WHEN NOT wd OR NOT direct THEN 0 WHEN wo THEN 8 ELSE 15 END AS ap,
    CASE WHEN NOT wo OR NOT official THEN 0 WHEN wd THEN 7 ELSE 15 END AS op,
    CAST(months IS NOT NULL AND months >= CAST(CASE WHEN mm = '' THEN '0' ELSE mm END AS INT) AS INT)
      + CAST(employment_type IS NOT NULL AS INT) + CAST(deadline IS NOT NULL AS INT) + 1 + 1 AS det,
    CAST(floor(40.0 * len(hit) / len(tokens) + 0.5) AS INT) AS rp FROM u)
SELECT profile_id, id, CAST(least(100, rp + CASE WHEN ch THEN cm ELSE 0 END + CASE WHEN lh THEN lm ELSE 0 END + dp + ap + op + 2 * det) AS INT) AS score,
  concat_ws('|', CASE WHEN rp > 0 THEN concat('Research terms matched: ', array_to_string(hit, ', '), ' (+', rp, ')') END,
    CASE WHEN ch THEN concat('Preferred country matched: ', country, ' (+', cm, ')') END,
    CASE WHEN lh THEN concat('Preferred source language matched (+', lm, ')') END,
    CASE WHEN dp > 0 THEN 'Deadline preference matched (+15)' END,
    CASE WHEN ap > 0 THEN concat('Separate direct application is available (+', ap, ')') END,
    CASE WHEN op > 0 THEN concat('Institution-owned official source (+', op, ')') END,
    concat(det, ' of 5 comparison details are stated (+', 2 * det, ')')) AS reasons FROM w"""


def _scores(spark, d):
    public = present.public_view(view(spark, d, "postings"), view(spark, d, "source_dim"))
    return score.preference_scores(view(spark, d, "shown"), public, view(spark, d, "profiles"), AS_OF), public


@register("preference_scores", "postings", "profiles", "shown", "source_dim", oracle=SCORE_SQL)
def _preference(spark, d):
    return _scores(spark, d)[0].select("profile_id", "id", "score", "reasons")


@register(
    "score_for_profile", "postings",
    oracle=f"""SELECT id, CAST(CASE WHEN contains(lower(title), 'machinery') THEN 40 ELSE 0 END + CASE WHEN country = 'NATION_2' THEN 20 ELSE 0 END
      + CASE WHEN deadline >= {DAY} THEN 15 ELSE 0 END + 2 * (CAST(coalesce(duration = '2 years', FALSE) AS INT) + CAST(employment_type IS NOT NULL AS INT)
      + CAST(deadline IS NOT NULL AS INT) + 2) AS INT) AS score FROM postings_v""",
)
def _one_profile(spark, d):
    public = present.public_view(view(spark, d, "postings"), view(spark, d, "source_dim"))
    profile = {"profile_id": "p", "research_keywords": "Machinery", "countries": "Nation_2", "deadline": "open", "minimum_duration_months": "20"}
    return score.score_for_profile(public, profile, AS_OF).select("id", "score")


@register(
    "profile_terms", "profiles",
    oracle="""SELECT profile_id, concat(lower(split(research_keywords, ' ')[1]), '|order') AS tokens,
      CASE WHEN countries = '' THEN '' WHEN countries = 'NATION_1; NATION_1' THEN 'nation 1' ELSE concat(replace(lower(split(countries, ';')[1]), '_', ' '), '|nation 1') END AS country_list,
      CASE WHEN source_languages = '' THEN '' ELSE 'en|de' END AS language_list, deadline AS deadline_wish,
      CAST(nullif(minimum_duration_months, '') AS INT) AS minimum_months, TRUE AS has_preferences FROM profiles_v""",
)
def _terms(spark, d):
    return score.profile_terms(view(spark, d, "profiles")).drop("wants_direct", "wants_official")


COMPARE_SQL = f"""
WITH sc AS ({SCORE_SQL}),
b AS (SELECT s.profile_id, p.*, coalesce(sd.institution_owned, FALSE) AS off_, sc.score, sc.reasons FROM shown_v s JOIN postings_v p ON p.id = s.id
  LEFT JOIN source_dim_v sd ON sd.source_key = p.source_key LEFT JOIN sc ON sc.profile_id = s.profile_id AND sc.id = p.id),
r AS (SELECT profile_id, id, unnest([
  {{'row_no': 0, 'label': 'Position', 'value': title}}, {{'row_no': 1, 'label': 'Institution', 'value': institution}},
  {{'row_no': 2, 'label': 'City', 'value': city}}, {{'row_no': 3, 'label': 'Country', 'value': country}},
  {{'row_no': 4, 'label': 'Research areas', 'value': research_area}},
  {{'row_no': 5, 'label': 'Source language', 'value': CASE source_language WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'Spanish' END}},
  {{'row_no': 6, 'label': 'Posted date', 'value': strftime(posted_at, '%b %-d, %Y')}},
  {{'row_no': 7, 'label': 'Deadline', 'value': coalesce(strftime(deadline, '%b %-d, %Y'), 'Not stated')}},
  {{'row_no': 8, 'label': 'Duration', 'value': coalesce(duration, 'Not stated')}},
  {{'row_no': 9, 'label': 'Employment type', 'value': coalesce(employment_type, 'Not stated')}},
  {{'row_no': 10, 'label': 'Salary or funding', 'value': 'Not stated'}},
  {{'row_no': 11, 'label': 'Official source', 'value': concat(CASE WHEN off_ THEN 'Yes - ' ELSE 'No - ' END, source_name)}},
  {{'row_no': 12, 'label': 'Direct application available', 'value': CASE WHEN apply_url <> source_url THEN 'Yes' ELSE 'No' END}},
  {{'row_no': 13, 'label': 'Source count', 'value': '1'}},
  {{'row_no': 14, 'label': 'Last verified', 'value': strftime(last_verified_at, '%b %-d, %Y')}},
  {{'row_no': 15, 'label': 'Preference match', 'value': concat(score, '/100 - ', replace(reasons, '|', '; '))}},
  {{'row_no': 16, 'label': 'Source action', 'value': CASE WHEN off_ THEN 'View official source' ELSE 'View original source' END}},
  {{'row_no': 17, 'label': 'Apply action', 'value': CASE WHEN apply_url = source_url THEN 'View application details' ELSE 'View and apply' END}}]) AS c FROM b)
SELECT profile_id, id, c.row_no AS row_no, c.label AS label, c.value AS value FROM r"""


@register("comparison_rows", "postings", "profiles", "shown", "source_dim", oracle=COMPARE_SQL)
def _comparison(spark, d):
    scores, public = _scores(spark, d)
    rows = view(spark, d, "shown").join(public, "id")
    cells = present.comparison_rows(rows, scores, ("profile_id", "id"))
    return cells.select("profile_id", "id", "row_no", "label", "value")


SELECTED_SQL = """k AS (SELECT profile_id, job_id, min(seq) AS seq FROM selection_events_v WHERE trim(job_id) <> '' GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY seq) AS pos FROM k)"""


@register(
    "select_positions", "selection_events",
    oracle=f"""WITH {SELECTED_SQL}, f AS (SELECT * FROM r WHERE pos <= 3)
      SELECT e.profile_id, CASE WHEN trim(e.job_id) = '' THEN 'invalid' WHEN e.seq = f.seq THEN 'added' WHEN f.seq IS NOT NULL THEN 'duplicate' ELSE 'limit' END AS status, count(*) AS n
      FROM selection_events_v e LEFT JOIN f ON f.profile_id = e.profile_id AND f.job_id = e.job_id GROUP BY 1, 2""",
)
def _select(spark, d):
    rows = selection.select_positions(view(spark, d, "selection_events"))
    return rows.groupBy("profile_id", "status").agg(F.count("*").alias("n"))


@register(
    "reconcile_selection", "selection_events", "postings",
    oracle="""SELECT e.profile_id, min(e.seq) AS pos, e.job_id FROM selection_events_v e
      WHERE trim(e.job_id) <> '' AND EXISTS (SELECT 1 FROM postings_v p WHERE p.id = e.job_id AND p.is_active) GROUP BY e.profile_id, e.job_id""",
)
def _reconcile(spark, d):
    events = view(spark, d, "selection_events").withColumnRenamed("seq", "pos")
    return selection.reconcile_selection(events, view(spark, d, "postings").where("is_active"))


@register(
    "saved_only", "selection_events", "postings",
    oracle="SELECT id, title FROM postings_v WHERE id IN (SELECT job_id FROM selection_events_v)",
)
def _saved(spark, d):
    return selection.saved_only(view(spark, d, "postings"), view(spark, d, "selection_events")).select("id", "title")


@register(
    "merge_pages", "postings",
    oracle="""WITH pg AS (SELECT id, CAST(o_orderkey % 3 AS INT) AS page_no, row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY id) AS pos, title FROM postings_v
        UNION ALL SELECT id, CAST(3 + o_orderkey % 2 AS INT), row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY id), concat(title, ' again') FROM postings_v WHERE is_active)
      SELECT id, min(page_no) AS page_no, max(CASE WHEN page_no >= 3 THEN title END) IS NOT NULL AS repeated, arg_max(title, page_no) AS title FROM pg GROUP BY id""",
)
def _pages(spark, d):
    jobs = view(spark, d, "postings")
    key = F.col("o_orderkey")
    first = jobs.select((key % 3).cast("int").alias("page_no"), key.alias("pos"), "id", "title", F.lit(False).alias("repeated"))
    again = jobs.where("is_active").select(
        (3 + key % 2).cast("int").alias("page_no"), key.alias("pos"), "id", F.concat("title", F.lit(" again")).alias("title"), F.lit(True).alias("repeated")
    )
    return search.merge_pages(first.unionByName(again)).select("id", "page_no", "repeated", "title")
