"""A training corpus from raw documents, in stages; each is written as Parquet and read again by the next.

Documents the classifier rejects go; of each group of near copies the document with the least id
stays; documents that hold a benchmark item go; sources are mixed to their target weights, which
repeats, cuts or leaves out documents; and what is left gets its shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postlake.llm import decontaminate, mixing, neardup, quality, sharding
from postlake.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts; it learns from this run's labels."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return neardup.without_near_duplicates(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item is found."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, repeated and cut as their source's budget asks."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document of the mix is stored."""
    return sharding.digest(sharding.assign(docs, sharding.tree()))


STAGES: list[tuple[str, Stage]] = [
    ("quality", classify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL can express neither the learned scores nor the signatures; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
