"""JSON listings and details to entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake import rules
from postlake.functions.text import html_text, strip
from postlake.functions.urls import with_address
from postlake.sources.listings import approved, with_source

_LISTING = (
    "total int, jobPostings array<struct<title:string,externalPath:string,locationsText:string,"
    "postedOn:string,bulletFields:array<string>>>"
)
_DETAIL = (
    "jobPostingInfo struct<title:string,jobDescription:string,location:string,startDate:string,"
    "endDate:string,timeType:string,jobReqId:string,jobPostingId:string,posted:boolean,"
    "canApply:boolean,externalUrl:string>"
)
#: Category every posting of the API source carries.
API_CATEGORY = "Life Sciences"


def api_listings(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, source_key, json)`` to one row per posting; the last duplicate wins."""
    postings = (
        docs.select(
            "doc_id", "source_key",
            F.posexplode(F.from_json("json", _LISTING)["jobPostings"]).alias("pos", "p"),
        )
        .where(F.col("p.externalPath").isNotNull())
        .select(
            "doc_id", "source_key", "pos",
            strip(
                F.coalesce(F.try_element_at("p.bulletFields", F.lit(1)), F.col("p.externalPath"))
            ).alias("source_item_id"),
            F.col("p.externalPath").alias("external_path"),
            strip(F.coalesce("p.title", F.lit(""))).alias("title"),
            strip(F.coalesce("p.locationsText", F.lit(""))).alias("location"),
            strip(F.coalesce("p.postedOn", F.lit(""))).alias("posted_on"),
        )
    )
    row = F.struct("external_path", "title", "location", "posted_on")
    return (
        postings.groupBy("doc_id", "source_key", "source_item_id")
        .agg(F.min("pos").alias("pos"), F.max_by(row, "pos").alias("row"))
        .select("doc_id", "source_key", "pos", "source_item_id", "row.*")
    )


def api_details(details: DataFrame, listings: DataFrame, sources: DataFrame) -> DataFrame:
    """``details(source_key, external_path, json)`` left-joined to listings, as entries.

    A listing path found in several listings is taken once, so details never multiply.
    """
    by_path = (
        listings.groupBy("source_key", "external_path")
        .agg(F.min_by(F.struct("source_item_id", "title", "location"), "pos").alias("listing"))
    )
    rows = with_source(details.join(by_path, ["source_key", "external_path"], "left"), sources)
    rows = rows.withColumn("p", F.from_json("json", _DETAIL)["jobPostingInfo"])
    path = F.coalesce(
        F.nullif("external_path", F.lit("")),
        F.concat(F.lit("/job/"), F.coalesce("p.jobPostingId", F.lit(""))),
    )
    rows = rows.withColumn("path", path).withColumn(
        "href",
        F.coalesce(
            F.nullif("p.externalUrl", F.lit("")), F.concat("source.listing_url", F.col("path"))
        ),
    )
    rows = with_address(with_address(rows, "source.listing_url", "root"), "href", "link", "root")
    place = strip(F.coalesce(F.nullif("p.location", F.lit("")), "listing.location", F.lit("")))
    rows = rows.withColumn("place", place)
    city, country = F.split("place", ",")[0], F.lit("")
    for name, land in reversed(rules.API_CITIES):
        here = F.lower("place").contains(name.lower())
        city = F.when(here, name).otherwise(city)
        country = F.when(here, land).otherwise(country)
    url = F.when(approved(F.col("link"), F.col("source.hosts")), F.col("link.url"))
    item = strip(F.coalesce("p.jobReqId", "listing.source_item_id", "path"))
    rows = rows.withColumn(
        "text", F.lower(html_text(F.coalesce("p.jobDescription", F.lit("")), None))
    )
    by_text = F.exists("source.closed_signals", lambda s: F.col("text").contains(F.lower(s)))
    return rows.select(
        "source_key",
        strip(F.coalesce("p.title", "listing.title", F.lit(""))).alias("title"),
        F.coalesce("p.jobDescription", F.lit("")).alias("description_html"),
        url.alias("link"),
        item.alias("guid"),
        item.alias("source_item_id"),
        strip(F.coalesce("p.startDate", F.lit(""))).alias("pub_date"),
        F.array(F.lit(API_CATEGORY)).alias("categories"),
        F.col("source.default_institution").alias("institution"),
        country.alias("country"),
        strip(city).alias("city"),
        strip(F.coalesce("p.endDate", F.lit(""))).alias("deadline"),
        F.lit("").alias("duration"),
        strip(F.coalesce("p.timeType", F.lit(""))).alias("employment_type"),
        url.alias("apply_url"),
        F.col("source.default_language_code").alias("source_language"),
        F.lit("api").alias("source_type"),
        (
            F.coalesce(~F.col("p.posted"), F.lit(False))
            | F.coalesce(~F.col("p.canApply"), F.lit(False))
            | by_text
        ).alias("closed"),
    )
