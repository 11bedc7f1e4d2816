"""Feed documents to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import strip

PROHIBITED_DECLARATION = r"(?i)<!\s*(?:DOCTYPE|ENTITY)"

_TEXT = "struct<_VALUE:string,_href:string,_url:string>"
_ITEM = (
    f"array<struct<title:{_TEXT},description:{_TEXT},summary:{_TEXT},`content:encoded`:{_TEXT},"
    f"link:{_TEXT},guid:{_TEXT},id:{_TEXT},pubDate:{_TEXT},published:{_TEXT},`dc:date`:{_TEXT},"
    f"category:array<{_TEXT}>>>"
)
_FEED = f"channel struct<item:{_ITEM}>, item {_ITEM}, _corrupt_record string"


def parse_feeds(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, source_key, xml)`` plus the parsed feed and ``rejected`` (reason or NULL)."""
    parsed = docs.withColumn(
        "feed",
        F.when(
            ~F.col("xml").rlike(PROHIBITED_DECLARATION),
            F.from_xml("xml", _FEED, {"mode": "PERMISSIVE", "ignoreNamespace": "false"}),
        ),
    )
    return parsed.withColumn(
        "rejected",
        F.when(strip(F.coalesce("xml", F.lit(""))) == "", None)
        .when(F.col("xml").rlike(PROHIBITED_DECLARATION), "prohibited declaration")
        .when(F.col("feed").isNull() | F.col("feed._corrupt_record").isNotNull(), "invalid XML"),
    )


def _text(field: Column) -> Column:
    return F.coalesce(field["_VALUE"], field["_href"], field["_url"])


def feed_items(docs: DataFrame) -> DataFrame:
    """One row per item of every sound feed document (RSS channel or RDF)."""
    feeds = parse_feeds(docs).where(F.col("rejected").isNull())
    items = feeds.select(
        "doc_id",
        "source_key",
        F.posexplode(F.coalesce(F.col("feed.channel.item"), F.col("feed.item"))).alias(
            "pos", "item"
        ),
    )
    item = F.col("item")

    def first(*names: str) -> Column:
        return F.coalesce(*[_text(item[name]) for name in names], F.lit(""))

    return items.select(
        "doc_id",
        "source_key",
        "pos",
        strip(first("title")).alias("title"),
        first("content:encoded", "description", "summary").alias("description_html"),
        strip(first("link")).alias("link"),
        strip(first("guid", "id")).alias("guid"),
        strip(first("pubDate", "published", "dc:date")).alias("pub_date"),
        F.filter(
            F.transform(
                F.coalesce(item["category"], F.array().cast(f"array<{_TEXT}>")),
                lambda c: strip(_text(c)),
            ),
            lambda c: c != "",
        ).alias("categories"),
    )


def feed_quarantine(docs: DataFrame) -> DataFrame:
    """Documents that are not read, with the reason."""
    return (
        parse_feeds(docs)
        .where(F.col("rejected").isNotNull())
        .select("doc_id", "source_key", "rejected")
    )
