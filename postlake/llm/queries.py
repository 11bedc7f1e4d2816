"""The registered queries of this subpackage and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postlake.llm import (
    decontaminate, html_text, licenses, mixing, neardup, packing, quality, resampling, secrets, sharding, spelling, vptree, warc,
)
from postlake.llm.common import load
from postlake.llm.oracles import ORACLES

Run = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(load(spark, sf_dir, "documents")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, sf_dir, "documents"), width=4, percent=80)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in each document; documents without any are not listed."""
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(load(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find_licenses(load(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.assign(load(spark, sf_dir, "documents"), sharding.tree()))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(load(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(load(spark, sf_dir, "documents"), garble_every=199))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.drop("key")


QUERIES: dict[str, Run] = {
    "op1_secrets": op1_secrets,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_decontamination": op3_decontamination,
    "op4_neighbours": op4_neighbours,
    "op5_quality": op5_quality,
    "op6_licenses": op6_licenses,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_html_text": op9_html_text,
    "op10_warc": op10_warc,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_resampling": op12_resampling,
    "op13_packing": op13_packing,
}
__all__ = ["ORACLES", "QUERIES"]
