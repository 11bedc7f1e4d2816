"""Public columns, display labels and comparison rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import rules
from postlake.functions.once import bind
from postlake.functions.text import strip
from postlake.functions.urls import comparable
from postlake.session import cut


def language_code(value: Column) -> Column:
    def code_of(text: Column) -> Column:
        out = F.when(text == "", "unknown")
        for code, label in rules.LANGUAGES:
            out = out.when(text.isin(code, label.lower()), code)
        return out.otherwise(F.substring(text, 1, 12))

    return bind(F.lower(strip(F.coalesce(value, F.lit("")))), code_of)


def language_label(value: Column) -> Column:
    def label_of(code: Column) -> Column:
        out = F.upper(code)
        for known, label in rules.LANGUAGES:
            out = F.when(code == known, label).otherwise(out)
        return out

    return bind(language_code(value), label_of)


def display_date(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "MMM d, yyyy"), F.lit("No stated deadline"))


def direct_application(apply_url: Column, source_url: Column) -> Column:
    return bind(
        F.struct(comparable(apply_url).alias("a"), comparable(source_url).alias("s")),
        lambda u: u["a"].isNotNull() & F.coalesce(u["a"] != u["s"], F.lit(True)),
    )


def source_counts(observations: DataFrame) -> DataFrame:
    """Active observations per job; partial counts are made before the shuffle."""
    return (
        observations.where(F.col("observation_state") == "active")
        .groupBy("job_id")
        .agg(F.count("*").alias("source_count"))
    )


def public_view(jobs: DataFrame, sources: DataFrame, observations: DataFrame | None = None) -> DataFrame:
    """Columns shown to the public, with source facts; missing observations count as none."""
    dim = sources.select("source_key", F.col("name").alias("registered_name"), "institution_owned")
    rows = jobs.join(dim, "source_key", "left")
    if observations is None:
        rows = rows.withColumn("source_count", F.lit(1).cast("long"))
    else:
        counts = source_counts(observations).withColumnRenamed("job_id", "id")
        rows = rows.join(counts, "id", "left").withColumn(
            "source_count", F.coalesce("source_count", F.lit(0).cast("long"))
        )
    return rows.select(
        "id", "title", "institution", "country", "city", "research_area", "language",
        F.coalesce("source_language", F.lit("unknown")).alias("source_language"),
        F.coalesce("source_name", "registered_name").alias("source_name"),
        F.coalesce("institution_owned", F.lit(False)).alias("official_source"),
        "source_count", "last_verified_at", "description", "apply_url", "source_url", "deadline",
        "posted_at", "created_at", "updated_at", "employment_type", "duration", "tags", "is_demo",
    )


def page_view(page: DataFrame, sources: DataFrame, observations: DataFrame) -> DataFrame:
    """Public columns of one result page.

    A page has at most a hundred rows, so its ids are broadcast and observations are filtered
    by them where they are read; only those few are counted. The page is written down first,
    so that postings are scanned once for its two uses.
    """
    page = cut(page, "page")
    ids = F.broadcast(page.select(F.col("id").alias("job_id")))
    shown = public_view(page, sources, observations.join(ids, "job_id", "left_semi"))
    # The joins do not keep the page's order; its few rows are ordered again in one partition.
    return shown.coalesce(1).sortWithinPartitions(F.desc("posted_at"), F.desc("created_at"), F.desc("id"))


def presentation_flags(jobs: DataFrame, as_of: dt.date) -> DataFrame:
    """Add labels and flags a result card shows."""
    day = F.lit(as_of)
    left = F.datediff("deadline", day)
    part = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    place = F.concat_ws(", ", part(F.col("city")), part(F.col("country")))
    return jobs.withColumns(
        {
            "location_label": F.concat_ws(" · ", F.nullif(place, F.lit("")), part(F.col("language"))),
            "language_label": language_label(F.col("source_language")),
            "is_expired": F.coalesce(left < 0, F.lit(False)),
            "closing_soon": F.coalesce(left.between(0, 7), F.lit(False)),
            "direct_application": direct_application(F.col("apply_url"), F.col("source_url")),
            "deadline_label": display_date(F.col("deadline")),
        }
    )


def comparison_rows(jobs: DataFrame, scores: DataFrame | None = None, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Eighteen labelled rows for each row of the public view: ``*keys, row_no, key, label, value, href``.

    ``scores(*keys, score, reasons)`` fills the preference row.
    """
    rows = jobs
    if scores is None:
        rows = rows.withColumn("score", F.lit(None).cast("int")).withColumn(
            "reasons", F.lit(None).cast("array<string>")
        )
    else:
        rows = rows.join(scores.select(*keys, "score", "reasons"), list(keys), "left")
    missing = F.lit(rules.NOT_STATED)
    stated = lambda c: F.coalesce(F.nullif(strip(c.cast("string")), F.lit("")), missing)
    day = lambda c: F.coalesce(F.date_format(c, "MMM d, yyyy"), missing)
    link = lambda c: F.when(comparable(c).isNotNull(), F.trim(c))
    source_url, apply_url = link(F.col("source_url")), link(F.col("apply_url"))
    name = stated(F.col("source_name"))
    by = F.when(name == rules.NOT_STATED, "").otherwise(F.concat(F.lit(" - "), name))
    official = F.col("official_source")
    reasons = F.coalesce(
        F.nullif(F.array_join("reasons", "; "), F.lit("")), F.lit("No weighted criteria matched")
    )
    preference = F.when(
        F.col("score").isNotNull(),
        F.concat(F.col("score").cast("string"), F.lit("/100 - "), reasons),
    ).otherwise(missing)
    same = F.coalesce(comparable(F.col("apply_url")) == comparable(F.col("source_url")), F.lit(False))
    none = F.lit(None).cast("string")
    cells = {
        "position": ( stated(F.col("title")), none),
        "institution": ( stated(F.col("institution")), none),
        "city": ( stated(F.col("city")), none),
        "country": ( stated(F.col("country")), none),
        "research": ( stated(F.col("research_area")), none),
        "source-language": ( language_label(F.col("source_language")), none),
        "posted": ( day(F.col("posted_at")), none),
        "deadline": ( day(F.col("deadline")), none),
        "duration": ( stated(F.col("duration")), none),
        "employment": ( stated(F.col("employment_type")), none),
        "salary": ( missing, none),
        "official": (
            F.when(official, F.concat(F.lit("Yes"), by)).when(~official, F.concat(F.lit("No"), by)).otherwise(missing),
            none,
        ),
        "direct": (
            F.when(direct_application(F.col("apply_url"), F.col("source_url")), "Yes").otherwise("No"),
            none,
        ),
        "sources": ( stated(F.col("source_count")), none),
        "verified": ( day(F.col("last_verified_at")), none),
        "preference": ( preference, none),
        "source-action": (
            F.when(source_url.isNull(), missing).when(official, "View official source").otherwise("View original source"),
            source_url,
        ),
        "apply-action": (
            F.when(apply_url.isNull(), missing).when(same, "View application details").otherwise("View and apply"),
            apply_url,
        ),
    }
    array = F.array(
        *[
            F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), cells[key][0].alias("value"), cells[key][1].alias("href"))
            for key, label in rules.COMPARISON
        ]
    )
    return rows.select(*keys, F.posexplode(array).alias("row_no", "cell")).select(
        *keys, "row_no", "cell.*"
    )


def side_by_side(cells: DataFrame, ids: list[str]) -> DataFrame:
    """Comparison rows of at most three chosen postings, one column per posting."""
    if len(ids) > rules.MAX_COMPARED:
        raise ValueError(f"at most {rules.MAX_COMPARED} postings can be compared")
    return (
        cells.where(F.col("id").isin(ids))
        .groupBy("row_no", "key", "label")
        .pivot("id", ids)
        .agg(F.first("value"))
        .orderBy("row_no")
    )
