"""Preference profiles and explained scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import rules
from postlake.functions.once import bind, with_once
from postlake.functions.text import nfkd, words
from postlake.operators.present import direct_application, language_code


def profile_terms(profiles: DataFrame) -> DataFrame:
    """Add the normalised terms of each profile.

    ``profiles(profile_id, research_keywords, countries, source_languages, deadline,
    minimum_duration_months, require_direct_application, prefer_official_source)``.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    tokens = F.array_distinct(
        F.filter(F.split("__keywords", " "), lambda t: F.length(t) > 1)
    )

    def listed(c: str) -> Column:
        parts = F.transform(F.split(c, r"[,;\n]+"), lambda p: words(p))
        return F.array_distinct(F.filter(parts, lambda p: p != ""))

    months = F.coalesce(F.col("minimum_duration_months").cast("string"), F.lit(""))
    rows = profiles.withColumns(
        {
            "__keywords": words(nfkd(text("research_keywords"))),
            "__countries": nfkd(text("countries")),
            "__languages": nfkd(text("source_languages")),
            "deadline_wish": F.when(F.col("deadline").isin("open", "30", "60"), F.col("deadline")).otherwise(""),
            "minimum_months": F.when(
                months.rlike(r"^\d+$"), months.try_cast("int")
            ),
            "wants_direct": F.coalesce("require_direct_application", F.lit(False)),
            "wants_official": F.coalesce("prefer_official_source", F.lit(False)),
        }
    )
    rows = rows.withColumns(
        {
            "tokens": tokens,
            "country_list": listed("__countries"),
            "language_list": F.array_distinct(
                F.transform(listed("__languages"), lambda c: language_code(c))
            ),
        }
    )
    filled = (
        (F.trim(text("research_keywords")) != "")
        | (F.trim(text("countries")) != "")
        | (F.trim(text("source_languages")) != "")
        | (F.col("deadline_wish") != "")
        | F.col("minimum_months").isNotNull()
        | F.col("wants_direct")
        | F.col("wants_official")
    )
    return rows.withColumn("has_preferences", filled).select(
        "profile_id", "tokens", "country_list", "language_list", "deadline_wish",
        "minimum_months", "wants_direct", "wants_official", "has_preferences",
    )


def duration_months(duration: Column) -> Column:
    """Months in a duration text.

    The text is reduced to words first, so ``1.5 years`` reads as ``1 5 years``, that is 60
    months. Kept as it is: scores must stay comparable.
    """
    return bind(words(duration), _months)


def _months(text: Column) -> Column:
    years = F.regexp_extract(text, r"(\d{1,6})\s*years?", 1)
    months = F.regexp_extract(text, r"(\d{1,6})\s*months?", 1)
    return F.when(years != "", years.try_cast("int") * 12).when(months != "", months.try_cast("int"))


def posting_text(jobs: DataFrame) -> DataFrame:
    """Reduce public rows to what scoring reads; normal forms are computed once per posting."""
    joined = F.concat_ws(" ", "title", "research_area", "description", F.array_join("tags", " "))
    return jobs.select(
        "id",
        words(nfkd(joined)).alias("searchable"),
        words(nfkd(F.col("country"))).alias("country_words"),
        F.coalesce("country", F.lit("")).alias("country"),
        (F.coalesce("city", F.lit("")) != "").alias("has_city"),
        language_code(F.col("source_language")).alias("language"),
        "deadline",
        direct_application(F.col("apply_url"), F.col("source_url")).alias("direct"),
        F.coalesce("official_source", F.lit(False)).alias("official"),
        duration_months(F.col("duration")).alias("months"),
        (F.coalesce("employment_type", F.lit("")) != "").alias("has_type"),
    )


def _criteria(as_of: dt.date) -> Column:
    """Array of (key, points, maximum, reason) over profile terms joined to posting text."""
    points_text = lambda text, points: F.concat(text, F.lit(" (+"), points.cast("string"), F.lit(")"))

    def criterion(wanted: Column, key: str, points: Column, maximum: Column, text: Column) -> Column:
        return F.when(
            wanted,
            F.struct(
                F.lit(key).alias("key"),
                points.cast("int").alias("points"),
                maximum.cast("int").alias("maximum"),
                F.when(points > 0, points_text(text, points.cast("int"))).alias("reason"),
            ),
        )

    called = dict(rules.CRITERIA)
    found = F.col("found")
    research = F.floor(F.lit(40) * F.size(found) / F.size("tokens") + 0.5)
    countries, languages = F.size("country_list") > 0, F.size("language_list") > 0
    country_max = F.when(countries & languages, 12).when(countries, 20).otherwise(0)
    language_max = F.when(countries & languages, 8).when(languages, 20).otherwise(0)
    country_hit = F.array_contains("country_list", F.col("country_words"))
    language_hit = F.array_contains("language_list", F.col("language"))
    days = F.datediff("deadline", F.lit(as_of))
    in_time = F.coalesce(
        (days >= 0)
        & (
            (F.col("deadline_wish") == "open")
            | ((F.col("deadline_wish") == "30") & (days <= 30))
            | ((F.col("deadline_wish") == "60") & (days <= 60))
        ),
        F.lit(False),
    )
    direct_max = F.when(F.col("wants_official"), 8).otherwise(15)
    official_max = F.when(F.col("wants_direct"), 7).otherwise(15)
    long_enough = F.coalesce(
        F.col("months") >= F.coalesce("minimum_months", F.lit(0)), F.lit(False)
    )
    details = [
        long_enough,
        F.col("has_type"),
        F.col("deadline").isNotNull(),
        (F.col("country") != "") & F.col("has_city"),
        F.col("language") != "unknown",
    ]
    complete = sum((d.cast("int") for d in details[1:]), details[0].cast("int"))
    hit = lambda cond, points: F.when(cond, points).otherwise(F.lit(0))
    return F.filter(
        F.array(
            criterion(
                F.size("tokens") > 0, "research", research, F.lit(40),
                F.concat(F.lit(called["research"]), F.array_join(found, ", ")),
            ),
            criterion(
                countries, "country", hit(country_hit, country_max), country_max,
                F.concat(F.lit(called["country"]), F.col("country")),
            ),
            criterion(
                languages, "source-language", hit(language_hit, language_max), language_max,
                F.lit(called["source-language"]),
            ),
            criterion(
                F.col("deadline_wish") != "", "deadline", hit(in_time, F.lit(15)), F.lit(15),
                F.lit(called["deadline"]),
            ),
            criterion(
                F.col("wants_direct"), "direct-application", hit(F.col("direct"), direct_max), direct_max,
                F.lit(called["direct-application"]),
            ),
            criterion(
                F.col("wants_official"), "official-source", hit(F.col("official"), official_max), official_max,
                F.lit(called["official-source"]),
            ),
            criterion(
                F.lit(True), "completeness", complete * 2, F.lit(10),
                F.concat(complete.cast("string"), F.lit(called["completeness"])),
            ),
        ),
        lambda c: c.isNotNull(),
    )


def _scored(rows: DataFrame, as_of: dt.date) -> DataFrame:
    rows = with_once(
        rows, "found", F.filter("tokens", lambda t: F.col("searchable").contains(t))
    )
    rows = with_once(rows.where(F.col("has_preferences")), "criteria", _criteria(as_of))
    total = F.aggregate("criteria", F.lit(0), lambda acc, c: acc + c["points"])
    return rows.select(
        "profile_id",
        "id",
        F.least(F.lit(100), total).alias("score"),
        F.filter(
            F.transform("criteria", lambda c: c["reason"]), lambda r: r.isNotNull()
        ).alias("reasons"),
        "criteria",
    )


def preference_scores(
    shown: DataFrame, jobs: DataFrame, profiles: DataFrame, as_of: dt.date
) -> DataFrame:
    """Score the postings shown to each profile, ``shown(profile_id, id)``, with every point explained.

    Only pairs that were shown are scored, through two key joins; profiles never meet all postings.
    """
    rows = shown.join(profile_terms(profiles), "profile_id").join(posting_text(jobs), "id")
    return _scored(rows, as_of)


def score_for_profile(jobs: DataFrame, profile: dict, as_of: dt.date) -> DataFrame:
    """Scores of all postings for one profile given as a parameter: a projection without a join."""
    spark = jobs.sparkSession
    columns = {
        "profile_id": "string", "research_keywords": "string", "countries": "string",
        "source_languages": "string", "deadline": "string", "minimum_duration_months": "string",
        "require_direct_application": "boolean", "prefer_official_source": "boolean",
    }
    one = spark.createDataFrame(
        [tuple(profile.get(c) for c in columns)], ", ".join(f"{c} {t}" for c, t in columns.items())
    )
    terms = profile_terms(one).first()
    rows = posting_text(jobs).withColumns(
        {
            "profile_id": F.lit(terms["profile_id"]),
            **{
                c: F.array(*[F.lit(v) for v in terms[c]]).cast("array<string>")
                for c in ("tokens", "country_list", "language_list")
            },
            "deadline_wish": F.lit(terms["deadline_wish"]),
            "minimum_months": F.lit(terms["minimum_months"]).cast("int"),
            "wants_direct": F.lit(terms["wants_direct"]),
            "wants_official": F.lit(terms["wants_official"]),
            "has_preferences": F.lit(terms["has_preferences"]),
        }
    )
    return _scored(rows, as_of)
