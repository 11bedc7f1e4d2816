"""Matching, merging, storing."""

from pyspark.sql import functions as F

from postlake import schemas
from postlake.operators import match, merge
from postlake.operators.accounting import batch_metrics
from postlake.operators.normalize import content_fingerprint
from postlake.plans.queries import AS_OF_TS, register, view
from postlake.session import cut, scratch_path
from postlake.sources.buckets import Store
from postlake.sources.tables import backfill_language, backfill_observations, copy_runs

_JOB_COLUMNS = [c.split()[0] for c in schemas.JOB.replace("\n", " ").split(",")]


def _jobs(spark, d):
    return content_fingerprint(view(spark, d, "postings", spread=True).select(*_JOB_COLUMNS))


def _incoming(spark, d):
    return content_fingerprint(view(spark, d, "incoming", spread=True).select("batch_seq", *_JOB_COLUMNS))


def _known(spark, d, jobs):
    empty = spark.createDataFrame([], schemas.OBSERVATION)
    own = backfill_observations(jobs, empty)
    known = view(spark, d, "known").where("NOT is_primary").select("job_id", "source_key", "source_item_id", "is_primary")
    extra = known.join(jobs.select(F.col("id").alias("job_id"), "first_seen_at"), "job_id")
    filled = extra.select(
        *[
            F.col(c) if c in extra.columns else F.lit(None).cast(own.schema[c].dataType).alias(c)
            for c in own.columns
        ]
    ).withColumns({"observation_state": F.lit("active"), "id": F.concat_ws("-", "job_id", "source_key")})
    return own.unionByName(filled)


SAME = " AND ".join(
    f"i.{c} IS NOT DISTINCT FROM j.{c}"
    for c in ("title", "institution", "country", "city", "research_area", "description", "apply_url", "deadline", "duration", "tags")
)
STEPS = {
    0: "JOIN st j ON i.source_key = j.source_key AND i.source_item_id = j.source_item_id",
    1: "JOIN known_v k ON i.source_key = k.source_key AND i.source_item_id = k.source_item_id JOIN st j ON j.id = k.job_id",
    2: "JOIN st j ON i.source_key = j.source_key AND i.canonical_url = j.canonical_url",
    3: "JOIN st j ON i.source_url = j.source_url",
    4: "JOIN st j ON i.apply_url = j.apply_url WHERE i.apply_url <> i.source_url",
    5: "JOIN st j ON i.canonical_url = j.canonical_url",
    6: "JOIN known_v k ON i.source_item_id = k.source_item_id JOIN st j ON j.id = k.job_id AND lower(i.institution) = lower(j.institution)",
    7: "JOIN st j ON lower(i.institution) = lower(j.institution) AND lower(i.title) = lower(j.title) AND i.deadline = j.deadline",
    8: f"JOIN st j ON lower(i.institution) = lower(j.institution) AND lower(i.country) = lower(j.country) AND {SAME}",
}


def hits(steps):
    parts = " UNION ALL ".join(
        f"SELECT i.batch_seq, {min(n, 6)} AS step, j.first_seen_at, j.id AS job_id FROM incoming_v i {STEPS[n]}" for n in steps
    )
    return f"""st AS (SELECT * FROM postings_v WHERE origin_type = 'collected' AND NOT is_demo), hits AS ({parts}),
      best AS (SELECT batch_seq, step, job_id FROM hits QUALIFY row_number() OVER (PARTITION BY batch_seq ORDER BY step, first_seen_at, job_id) = 1)"""


V = ("postings", "incoming", "known")


def _match(*names):
    def put(name, fn, steps):
        @register(name, *V, oracle=f"WITH {hits(steps)} SELECT batch_seq, job_id, CAST(step AS INT) AS step FROM best")
        def run(spark, d):
            # Long texts count by their fingerprint alone.
            jobs = cut(_jobs(spark, d).drop("original_title", "original_description", "description", "tags"), "jobs")
            batch = cut(match.with_application(_incoming(spark, d)).select(*match.COMPARED), "batch")
            return fn(batch, jobs, _known(spark, d, jobs))

    for entry in names:
        put(*entry)


_match(
    ("match_identity", match.match_identity, (0, 1)),
    ("match_canonical", match.match_canonical, (2,)),
    ("match_source_url", match.match_source_url, (3,)),
    ("match_cross_source", match.match_cross_source, (4, 5, 6, 7, 8)),
    ("match_cascade", match.match_cascade, tuple(range(9))),
)

STORED = f"""{hits(range(9))},
 pri AS (SELECT source_key, priority FROM source_dim_v),
 firsts AS (SELECT i.*, row_number() OVER (PARTITION BY source_key, source_item_id ORDER BY batch_seq) AS nth FROM incoming_v i),
 act AS (SELECT i.batch_seq, i.source_key, coalesce(b.job_id, i.id) AS job_id, i.change, i.nth,
     b.job_id IS NOT NULL AND j.source_key <> i.source_key AS crossed,
     b.job_id IS NOT NULL AND j.source_key <> i.source_key AND ip.priority < jp.priority AS better,
     b.job_id IS NOT NULL AND {SAME} AS same
   FROM firsts i LEFT JOIN best b ON b.batch_seq = i.batch_seq LEFT JOIN st j ON j.id = b.job_id
   LEFT JOIN pri ip ON ip.source_key = i.source_key LEFT JOIN pri jp ON jp.source_key = j.source_key),
 done AS (SELECT *, CASE WHEN nth > 1 THEN 'touch' WHEN job_id NOT IN (SELECT id FROM st) THEN 'insert' WHEN same AND better THEN 'promote'
     WHEN same THEN 'touch' WHEN better THEN 'promote' ELSE 'update' END AS action FROM act),
 outcomes AS (SELECT *, CASE WHEN action = 'insert' THEN 'inserted' WHEN action = 'touch' OR same THEN 'unchanged' ELSE 'updated' END AS outcome FROM done)"""


def _stored(spark, d):
    jobs = cut(_jobs(spark, d), "jobs")
    return merge.upsert_postings(jobs, _known(spark, d, jobs), _incoming(spark, d), view(spark, d, "source_dim"))


@register("upsert_actions", *V, "source_dim", oracle=f"""WITH {STORED} SELECT batch_seq, job_id, source_key, action, outcome, crossed AS "cross" FROM outcomes""")
def _actions(spark, d):
    return _stored(spark, d).actions


@register(
    "upsert_counters", *V, "source_dim",
    oracle=f"""WITH {STORED} SELECT source_key, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'updated') AS updated,
      count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (crossed) AS duplicates_merged FROM outcomes GROUP BY source_key""",
)
def _upsert_counters(spark, d):
    return _stored(spark, d).counters_by_source()


@register(
    "upsert_postings", *V, "source_dim",
    oracle=f"""WITH {STORED}, o AS (SELECT * FROM outcomes WHERE nth = 1)
      SELECT p.id, CASE WHEN o.action = 'update' AND p.source_type <> 'html' THEN i.title ELSE p.title END AS title,
        CAST(CASE WHEN o.action = 'update' THEN i.deadline ELSE p.deadline END AS VARCHAR) AS deadline,
        CASE WHEN o.action = 'promote' THEN i.source_key ELSE p.source_key END AS source_key,
        CASE WHEN o.action = 'promote' THEN i.source_url ELSE p.source_url END AS source_url, p.source_type,
        CASE WHEN o.action IS NULL THEN p.collection_state ELSE 'active' END AS collection_state,
        o.action IS NOT NULL OR p.is_active AS is_active
      FROM postings_v p LEFT JOIN o ON o.job_id = p.id AND o.action <> 'insert' LEFT JOIN incoming_v i ON i.batch_seq = o.batch_seq
      UNION ALL SELECT i.id, i.title, CAST(i.deadline AS VARCHAR), i.source_key, i.source_url, i.source_type, 'active', TRUE
      FROM o JOIN incoming_v i ON i.batch_seq = o.batch_seq WHERE o.action = 'insert'""",
)
def _postings(spark, d):
    return _stored(spark, d).jobs.select(
        "id", "title", "deadline", "source_key", "source_url", "source_type", "collection_state", "is_active"
    )


def _whole_rows() -> str:
    """SQL for all columns of the jobs table after the batch."""
    old = lambda c: f"p.{c}"
    keep_page = "p.source_type = 'html' AND i.source_type = 'rss'"
    out = {c: f"CASE WHEN o.action IN ('update', 'promote') THEN i.{c} ELSE p.{c} END" for c in merge.EDITABLE}
    for c, stand_in in merge.PAGE_TEXT.items():
        kept = old(c) if stand_in is None else f"coalesce(nullif(p.{c}, ''), p.{stand_in})"
        out[c] = f"CASE WHEN o.action NOT IN ('update', 'promote') OR o.action IS NULL THEN p.{c} WHEN {keep_page} THEN {kept} ELSE i.{c} END"
    for c in ("deadline", "duration"):
        out[c] = f"CASE WHEN o.action IN ('update', 'promote') THEN coalesce(i.{c}, p.{c}) ELSE p.{c} END"
    link = "CASE WHEN i.apply_url <> i.source_url THEN i.apply_url WHEN p.apply_url <> p.source_url THEN p.apply_url ELSE i.apply_url END"
    out["apply_url"] = f"CASE WHEN o.action IN ('update', 'promote') THEN {link} ELSE p.apply_url END"
    out["source_type"] = "CASE WHEN o.action IN ('update', 'promote') THEN CASE WHEN 'html' IN (p.source_type, i.source_type) THEN 'html' ELSE 'rss' END ELSE p.source_type END"
    out["source_key"] = "CASE WHEN o.action IN ('update', 'promote') THEN i.source_key ELSE p.source_key END"
    out["source_item_id"] = "CASE WHEN o.action = 'promote' THEN i.source_item_id ELSE p.source_item_id END"
    out["updated_at"] = "CASE WHEN o.action IN ('update', 'promote') THEN i.updated_at ELSE p.updated_at END"
    for c in ("last_seen_at", "last_verified_at"):
        out[c] = f"coalesce(i.{c}, p.{c})"
    out |= {"collection_state": "CASE WHEN o.action IS NULL THEN p.collection_state ELSE 'active' END", "is_active": "o.action IS NOT NULL OR p.is_active"}
    out |= {"expiry_reason": "CASE WHEN o.action IS NULL THEN p.expiry_reason END"}
    fresh = {c: f"i.{c}" for c in _JOB_COLUMNS}

    def shown(c, v):
        if c in ("deadline", "posted_at"):
            return f"CAST({v} AS VARCHAR)"
        if c.endswith("_at"):
            return f"strftime({v}, '%Y-%m-%d %H:%M:%S')"
        return f"array_to_string({v}, '|')" if c == "tags" else v

    names = [c for c in _JOB_COLUMNS if c != "content_hash"]
    stored = ", ".join(f"{shown(c, out.get(c, old(c)))} AS {c}" for c in names)
    added = ", ".join(f"{shown(c, fresh[c])} AS {c}" for c in names)
    return f"""WITH {STORED}, o AS (SELECT * FROM outcomes WHERE nth = 1)
      SELECT {stored} FROM postings_v p LEFT JOIN o ON o.job_id = p.id AND o.action <> 'insert' LEFT JOIN incoming_v i ON i.batch_seq = o.batch_seq
      UNION ALL SELECT {added} FROM o JOIN incoming_v i ON i.batch_seq = o.batch_seq WHERE o.action = 'insert'"""


@register("upsert_whole_rows", *V, "source_dim", oracle=_whole_rows())
def _whole(spark, d):
    return _stored(spark, d).jobs.select(*[c for c in _JOB_COLUMNS if c != "content_hash"])


@register("stored_in_buckets", *V, "source_dim", oracle=_whole_rows())
def _bucketed(spark, d):
    """The same in two batches of a bucketed store, the second delivered twice."""
    store = Store(spark, scratch_path(spark, "store"), buckets=64)
    jobs = cut(_jobs(spark, d), "jobs")
    store.load(jobs, _known(spark, d, jobs))
    batch, ranks = cut(_incoming(spark, d), "batch"), view(spark, d, "source_dim")
    half = batch.agg(F.expr("percentile_approx(batch_seq, 0.5)")).first()[0]
    for number, part in ((2, batch.where(F.col("batch_seq") <= half)), (3, batch.where(F.col("batch_seq") > half)), (3, batch)):
        store.store(part, ranks, number)
    return store.read("jobs").select(*[c for c in _JOB_COLUMNS if c != "content_hash"])


@register(
    "stored_primary", *V, "source_dim",
    oracle=f"""WITH {STORED}, obs AS (SELECT job_id, source_key, source_item_id, is_primary, first_seen_at FROM known_v
        UNION ALL SELECT o.job_id, o.source_key, i.source_item_id, FALSE, i.first_seen_at FROM outcomes o JOIN incoming_v i ON i.batch_seq = o.batch_seq
          WHERE o.nth = 1 AND NOT EXISTS (SELECT 1 FROM known_v k WHERE k.source_key = o.source_key AND k.source_item_id = i.source_item_id)),
      ranked AS (SELECT obs.*, row_number() OVER (PARTITION BY job_id ORDER BY pri.priority, NOT is_primary, first_seen_at, obs.source_key, source_item_id) AS rn
        FROM obs LEFT JOIN pri ON pri.source_key = obs.source_key)
      SELECT job_id, source_key, source_item_id FROM ranked WHERE rn = 1""",
)
def _primary_after(spark, d):
    return _stored(spark, d).observations.where("is_primary").select("job_id", "source_key", "source_item_id")


@register(
    "merge_postings", "postings", "incoming",
    oracle="""SELECT p.id, i.batch_seq, CASE WHEN p.source_type = 'html' AND i.source_type = 'rss' THEN p.title ELSE i.title END AS title,
        CAST(coalesce(i.deadline, p.deadline) AS VARCHAR) AS deadline, CASE WHEN i.apply_url <> i.source_url THEN i.apply_url WHEN p.apply_url <> p.source_url THEN p.apply_url ELSE i.apply_url END AS apply_url,
        CASE WHEN p.source_type = 'html' OR i.source_type = 'html' THEN 'html' ELSE 'rss' END AS source_type, array_to_string(p.tags, '|') AS tags, i.source_key
      FROM postings_v p JOIN incoming_v i ON i.o_orderkey = p.o_orderkey""",
)
def _merge(spark, d):
    old, new = view(spark, d, "postings"), view(spark, d, "incoming")
    pairs = old.select("o_orderkey", F.struct(*_JOB_COLUMNS).alias("old")).join(
        new.select("o_orderkey", F.struct("batch_seq", *_JOB_COLUMNS).alias("new")), "o_orderkey"
    )
    merged = merge.merge_postings(pairs, keep=("new.batch_seq",))
    return merged.select("id", "batch_seq", "title", "deadline", "apply_url", "source_type", "tags", "source_key")


@register(
    "fold_batch", "deliveries",
    oracle="""WITH r AS (SELECT *, lag(title || city) OVER (PARTITION BY source_item_id ORDER BY batch_seq) AS before FROM deliveries_v),
      j AS (SELECT source_item_id, arg_max(title, batch_seq) AS title, arg_max(city, batch_seq) AS city, count(*) AS deliveries,
        count(*) FILTER (before IS NULL) AS inserted, count(*) FILTER (before <> title || city) AS updated, count(*) FILTER (before = title || city) AS unchanged
        FROM r GROUP BY source_item_id) SELECT * FROM j""",
)
def _fold(spark, d):
    rows = view(spark, d, "deliveries")
    url = F.concat(F.lit("https://feeds.example.org/"), "source_item_id")
    now = F.lit(AS_OF_TS)
    fixed = {
        "id": F.concat(F.lit("collected-"), "source_item_id"), "institution": F.lit("Institute"), "country": F.lit("Norway"),
        "research_area": F.lit("Physics"), "language": F.lit("English"), "source_language": F.lit("en"), "original_title": F.col("title"),
        "description": F.lit("Text"), "original_description": F.lit("Text"), "apply_url": url, "source_url": url, "canonical_url": url,
        "tags": F.array(F.lit("a")), "is_active": F.lit(True), "is_demo": F.lit(False), "origin_type": F.lit("collected"),
        "source_key": F.lit("feed"), "source_name": F.lit("Feed"), "source_type": F.lit("rss"), "collection_state": F.lit("active"),
        **{c: now for c in ("created_at", "updated_at", "first_seen_at", "last_seen_at", "last_verified_at")},
    }
    jobs = spark.createDataFrame([], schemas.JOB)
    batch = content_fingerprint(
        rows.select("batch_seq", *[
            (fixed[c] if c in fixed else F.col(c) if c in rows.columns else F.lit(None).cast(jobs.schema[c].dataType)).alias(c)
            for c in _JOB_COLUMNS
        ])
    )
    empty = spark.createDataFrame([], schemas.OBSERVATION)
    stored = merge.upsert_postings(jobs, empty, batch, view(spark, d, "source_dim"))
    tally = stored.actions.groupBy("job_id").agg(
        F.count("*").alias("deliveries"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("inserted", "updated", "unchanged")],
    )
    return stored.jobs.join(tally, F.col("id") == F.col("job_id")).select(
        "source_item_id", "title", "city", "deliveries", "inserted", "updated", "unchanged"
    )


@register(
    "upsert_observations", "observations",
    oracle="""WITH a AS (SELECT source_key, source_item_id, min(first_seen_at) AS f, max(first_seen_at) AS l FROM observations_v WHERE observation_state = 'expired' GROUP BY ALL),
      b AS (SELECT source_key, source_item_id, min(first_seen_at) AS f, max(first_seen_at) AS l FROM observations_v WHERE observation_state = 'active' GROUP BY ALL)
      SELECT source_key, source_item_id, strftime(coalesce(a.f, b.f), '%Y-%m-%d %H:%M:%S') AS first_seen_at, strftime(coalesce(b.l, a.l), '%Y-%m-%d %H:%M:%S') AS last_seen_at,
        CASE WHEN b.f IS NULL THEN 'expired' ELSE 'active' END AS observation_state
      FROM a FULL JOIN b USING (source_key, source_item_id)""",
)
def _observations(spark, d):
    rows = view(spark, d, "observations")
    seen = rows.withColumns(
        {
            "last_seen_at": F.col("first_seen_at"), "last_verified_at": F.col("first_seen_at"), "created_at": F.col("first_seen_at"),
            "updated_at": F.col("first_seen_at"), "batch_seq": F.unix_seconds("first_seen_at"), "collection_state": F.col("observation_state"),
            **{c: F.lit("x") for c in ("source_name", "source_type", "source_url", "apply_url", "source_language", "original_title", "title", "content_hash")},
        }
    )
    empty = spark.createDataFrame([], schemas.OBSERVATION)
    old = merge.upsert_observations(empty, seen.where("observation_state = 'expired'"))
    new = merge.upsert_observations(old, seen.where("observation_state = 'active'"))
    return new.select("source_key", "source_item_id", "first_seen_at", "last_seen_at", "observation_state")


@register(
    "primary_source", "observations",
    oracle="""WITH u AS (SELECT job_id, source_key, source_item_id, min(first_seen_at) AS f, l_suppkey % 7 AS priority, l_linenumber = 1 AS p FROM observations_v GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY priority, NOT p, f, source_key, source_item_id) AS rn FROM u)
      SELECT job_id, source_key, source_item_id FROM r WHERE rn = 1""",
)
def _primary(spark, d):
    rows = view(spark, d, "observations").groupBy("job_id", "source_key", "source_item_id", (F.col("l_linenumber") == 1).alias("is_primary")).agg(
        F.min("first_seen_at").alias("first_seen_at")
    )
    priorities = view(spark, d, "supplier").select(
        F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("source_key"), (F.col("s_suppkey") % 7).alias("priority")
    )
    return merge.primary_source(rows, priorities).where("is_primary").select("job_id", "source_key", "source_item_id")


@register(
    "batch_metrics", *V, "source_dim",
    oracle=f"""WITH {STORED}, e AS (SELECT source_key, count(*) AS received, count(*) FILTER (change <> 0) AS accepted, count(*) FILTER (change = 0) AS rejected FROM incoming_v GROUP BY source_key),
      c AS (SELECT source_key, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'updated') AS updated,
      count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (crossed) AS duplicates_merged FROM outcomes GROUP BY source_key)
      SELECT e.*, c.* EXCLUDE (source_key), 0 AS stale, 0 AS expired, 'success' AS status FROM e JOIN c USING (source_key)""",
)
def _metrics(spark, d):
    entries = view(spark, d, "incoming").select(
        "source_key", F.when(F.col("change") == 0, "rejected").otherwise("accepted").alias("disposition")
    )
    return batch_metrics(entries, _stored(spark, d).actions).drop("aged_out")


@register(
    "backfill_language", "postings",
    oracle="""SELECT id, CASE WHEN origin_type = 'collected' THEN CASE WHEN lower(language) = 'english' THEN 'en' ELSE 'unknown' END ELSE source_language END AS source_language,
      original_title FROM postings_v""",
)
def _backfill(spark, d):
    return backfill_language(view(spark, d, "postings")).select("id", "source_language", "original_title")


@register(
    "backfill_observations", "postings", "known",
    oracle="""SELECT concat('observation-', id) AS id, id AS job_id, source_key, source_item_id, collection_state AS observation_state, TRUE AS is_primary
      FROM postings_v WHERE origin_type = 'collected' AND NOT is_demo""",
)
def _backfill_observations(spark, d):
    made = backfill_observations(view(spark, d, "postings"), spark.createDataFrame([], schemas.OBSERVATION))
    return made.select("id", "job_id", "source_key", "source_item_id", "observation_state", "is_primary")


@register("copy_runs", "source_runs", oracle="SELECT message_id, status, CAST(NULL AS VARCHAR) AS summary_json FROM source_runs_v")
def _copy(spark, d):
    return copy_runs(view(spark, d, "source_runs"), ["message_id", "status", "summary_json"])
