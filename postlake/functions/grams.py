"""Substring search for many words at once, over q-gram postings.

Nothing is compared pair by pair: a word is looked up by the one of its grams that fewest texts hold,
so the candidates come from an equi-join on grams, and `contains` settles them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.session import cut

WIDTH = 3


def _grams(text: Column, width: int) -> Column:
    """The distinct runs of ``width`` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1)))


def containing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, text_id): which of ``needles`` (needle, not empty) stand in which of ``texts`` (text_id, text).

    Only the grams that some needle asks for are counted, and only each needle's rarest one is
    posted; a needle shorter than a gram is looked up by all of itself. Texts come into play once
    more, by their ids, to verify candidates.
    """
    needles = cut(needles.select("needle").where("needle != ''").distinct(), "needles")
    width = F.least(F.lit(WIDTH), F.length("needle"))
    widths = sorted(r[0] for r in needles.select(width.alias("w")).distinct().collect())  # three at most
    if not widths:
        return texts.select(F.lit("").alias("needle"), "text_id").limit(0)
    choice = F.coalesce(*[F.when(width == w, _grams(F.col("needle"), w)) for w in widths])
    asked = needles.select("needle", F.explode(choice).alias("gram"))
    asked = cut(asked, "asked-grams")
    held = texts.select("text_id", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("text"), w) for w in widths])))).alias("gram"))
    postings = held.join(asked.select("gram").distinct(), "gram", "left_semi")
    counts = postings.groupBy("gram").agg(F.count("*").alias("held"))
    rarest = asked.join(counts, "gram", "left").groupBy("needle").agg(
        F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), F.col("gram"))).alias("best")
    )
    rarest = cut(rarest.where("best.held > 0").select("needle", F.col("best.gram").alias("gram")), "rarest-grams")
    candidates = held.join(rarest, "gram").select("needle", "text_id")
    found = candidates.join(texts.select("text_id", "text"), "text_id").where(F.contains("text", "needle"))
    return found.select("needle", "text_id")
