"""Entries to rows of the jobs table; identity and content fingerprint."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import rules
from postlake.functions.dates import iso_date
from postlake.functions.text import html_text, strip
from postlake.functions.urls import with_address
from postlake.operators import facts
from postlake.session import cut
from postlake.sources.listings import with_source
from postlake.sources.pages import best_links, page_anchors, scored_links, usable_link

#: Columns of the content fingerprint, in the key order of their JSON form.
HASHED = (
    "apply_url", "city", "country", "deadline", "description", "duration", "institution",
    "research_area", "tags", "title",
)


def content_hash(value=F.col) -> Column:
    """SHA-256 of the key-sorted JSON of the compared columns, missing ones as null.

    ``value`` maps a column name to the column to hash, for rows built on the way.
    """
    fields = [
        (value(c).cast("string") if c == "deadline" else value(c)).alias(c) for c in HASHED
    ]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def content_fingerprint(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("content_hash", content_hash())


def duplicate_groups(rows: DataFrame, key: Column, hashed: Column) -> DataFrame:
    """Groups of rows with equal content: hash, size, smallest key. One row per hash is shuffled
    from each task, so a group holding a third of the table costs no more than any other."""
    return (
        rows.groupBy(hashed.alias("content_hash"))
        .agg(F.count("*").alias("copies"), F.min(key).alias("first_id"))
        .where(F.col("copies") > 1)
    )


def item_identity(source_url: Column) -> Column:
    """Registered id, else address, else guid, else hash of title and date."""
    filled = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    fallback = F.sha2(
        F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("pub_date", F.lit(""))), 256
    )
    return F.coalesce(
        filled(F.col("source_item_id")),
        F.nullif(source_url, F.lit("")),
        filled(F.col("guid")),
        fallback,
    )


def _with_own_address(rows: DataFrame) -> DataFrame:
    """Add ``own``, the address of ``page_url``, which is that of ``page`` or has another host.

    A canonical address is its own canonical form, so its parts are those of ``page``; only where the host
    also stands in path or query is it taken apart again.
    """
    url, page = F.col("page_url"), F.col("page")
    odd = (url != page["url"]) & F.concat(page["path"], page["query"]).contains("://")
    rows = with_address(rows.withColumn("__odd", F.when(odd, url)), "__odd", "__own")
    host = F.when(url == page["url"], page["host"]).otherwise(F.regexp_replace(page["host"], r"^www\.", ""))
    folder = F.substring(page["path"], F.lit(1), F.length(page["path"]) - F.length(F.substring_index(page["path"], "/", -1)))
    same = F.struct(
        url.alias("url"), page["scheme"].alias("scheme"), host.alias("host"), page["port"].alias("port"), page["path"].alias("path"),
        page["query"].alias("query"), F.lit("").alias("fragment"), folder.alias("folder"),
    )
    return rows.withColumn("own", F.when(F.col("__odd").isNotNull(), F.col("__own")).when(url.isNotNull(), same)).drop("__odd", "__own")


def normalize_postings(entries: DataFrame, sources: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Entries of the ``schemas.ENTRY`` form to rows of the ``schemas.JOB`` form.

    What an entry states wins over what its text implies.
    """
    located = with_address(sources, "listing_url", "listing")
    rows = with_address(with_source(entries, located), "link", "page")
    # One address for the www and the bare host, where only the bare one is approved.
    bare = F.regexp_replace(F.col("page.host"), r"^www\.", "")
    rows = rows.withColumn(
        "page_url",
        F.when(
            (F.col("page.host") != bare) & F.array_contains("source.hosts", bare),
            F.replace("page.url", F.concat(F.lit("://"), F.col("page.host")), F.concat(F.lit("://"), bare)),
        ).otherwise(F.col("page.url")),
    )
    rows = _with_own_address(rows)
    rows = rows.withColumns(
        {
            "clean_title": facts.clean_title(F.col("title")),
            "text": html_text(F.col("description_html"), None),
            "item_id": item_identity(F.col("page_url")),
        }
    ).withColumn("all_text", F.concat("clean_title", F.lit(". "), F.col("text")))

    # The key is fixed by content, so a lost task recomputes the same one. Links and the entries
    # themselves start here, so what was read so far is written once.
    rows = cut(
        rows.withColumn(
            "entry_key",
            F.sha2(
                F.to_json(F.struct("source_key", "item_id", "title", "description_html", "link", "apply_url")),
                256,
            ),
        ),
        "read-entries",
    )
    bodies = rows.select(
        F.col("entry_key").alias("page_id"), F.col("description_html").alias("html"), F.col("own").alias("page"), F.col("source.listing").alias("listing")
    )
    chosen = best_links(scored_links(page_anchors(bodies, carried=("page", "listing")))).select(
        F.col("page_id").alias("entry_key"), F.col("best.apply_url").alias("found_url")
    )
    rows = rows.join(chosen, "entry_key", "left")
    rows = with_address(rows, "apply_url", "stated", base="own")
    stated_ok = usable_link(F.col("apply_url"), F.col("stated"), F.col("source.listing"))
    rows = rows.withColumn(
        "apply", F.coalesce(F.when(stated_ok, F.col("stated.url")), "found_url", "page_url")
    )
    apply_host = F.regexp_extract("apply", "^https?://([^/?#:]*)", 1)  # all three are canonical

    stated = facts.clean_institution(F.col("institution"))
    in_title = facts.institution_in(F.col("clean_title"))
    rows = rows.withColumn(
        "employer",
        F.when(stated != "", stated)
        .when(in_title != rules.NO_INSTITUTION, in_title)
        .otherwise(facts.institution_in(F.col("text"))),
    ).withColumn("area", facts.area_of(F.col("all_text")))
    rows = rows.withColumn(
        "place",
        facts.location_in(
            F.col("all_text"), F.col("employer"), F.coalesce(apply_host, F.lit(""))
        ),
    )
    now = F.lit(as_of)
    today = F.to_date(now)
    published = iso_date(F.col("pub_date"))
    limit = F.to_date(now + F.expr("INTERVAL 48 HOURS"))
    stated_text = lambda c: strip(F.coalesce(c, F.lit("")))
    blank = F.lit("")
    language = F.lower(
        strip(F.coalesce(F.nullif("source_language", blank), "source.default_language_code", F.lit("unknown")))
    )
    duration = F.coalesce(
        F.nullif(facts.duration_in(F.coalesce("duration", blank)), blank),
        facts.duration_in(F.col("all_text")),
    )
    out = rows.select(
        F.concat(
            F.lit("collected-"),
            F.substring(F.sha2(F.concat_ws("\n", "source_key", "item_id"), 256), 1, 32),
        ).alias("id"),
        F.col("clean_title").alias("title"),
        F.col("employer").alias("institution"),
        F.coalesce(F.nullif(facts.clean_country(F.col("country")), blank), "place.country").alias("country"),
        F.coalesce(F.nullif(stated_text(F.col("city")), blank), "place.city").alias("city"),
        F.col("area").alias("research_area"),
        F.col("source.default_language").alias("language"),
        language.alias("source_language"),
        F.col("clean_title").alias("original_title"),
        F.col("text").alias("original_description"),
        F.rtrim(F.substring("text", 1, 1200)).alias("description"),
        F.col("apply").alias("apply_url"),
        F.col("page_url").alias("source_url"),
        F.coalesce(iso_date(F.col("deadline")), facts.deadline_in(F.col("all_text"))).alias("deadline"),
        F.when(published <= limit, published).otherwise(today).alias("posted_at"),
        F.coalesce(F.nullif(stated_text(F.col("employment_type")), blank), F.lit("Postdoctoral position")).alias("employment_type"),
        duration.alias("duration"),
        facts.tags_of(F.col("categories"), F.col("all_text"), F.col("area")).alias("tags"),
        F.lit(True).alias("is_active"),
        F.lit(False).alias("is_demo"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit("collected").alias("origin_type"),
        "source_key",
        F.col("source.name").alias("source_name"),
        F.col("item_id").alias("source_item_id"),
        now.alias("first_seen_at"),
        now.alias("last_seen_at"),
        now.alias("last_verified_at"),
        F.when(F.coalesce("closed", F.lit(False)), "expired").otherwise("active").alias("collection_state"),
        F.when(F.col("source_type") == "rss", "rss").otherwise("html").alias("source_type"),
        F.col("source.type").alias("observation_source_type"),
        F.col("page_url").alias("canonical_url"),
        F.lit(None).cast("string").alias("expiry_reason"),
    )
    return content_fingerprint(out)
