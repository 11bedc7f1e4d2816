"""Snapshots of the tables, and the one-off loads and migrations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.session import cut


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def snapshots(spark: SparkSession, root: str) -> list[int]:
    """Numbers of complete snapshots under ``root``, in order."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(root)):
        return []
    found = []
    for status in fs.listStatus(path(root)):
        name = status.getPath().getName()
        if name.startswith("snapshot=") and fs.exists(path(f"{root}/{name}/_SUCCESS")):
            found.append(int(name.split("=", 1)[1]))
    return sorted(found)


def write_snapshot(df: DataFrame, root: str, number: int | None = None, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> str:
    """Write ``df`` as the next snapshot (or as ``number``, replacing a failed or equal try).

    Readers see a snapshot only once Spark's success marker is there, so a lost job leaves the
    old one in force, and repeating a numbered write changes nothing.
    """
    spark = df.sparkSession
    if number is None:
        done = snapshots(spark, root)
        number = (done[-1] + 1) if done else 1
    target = f"{root}/snapshot={number}"
    if number in snapshots(spark, root):
        return target
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return target


def read_snapshot(spark: SparkSession, root: str, schema: str | None = None, number: int | None = None) -> DataFrame:
    """The newest complete snapshot, or an empty frame of ``schema`` if there is none."""
    done = [n for n in snapshots(spark, root) if number is None or n <= number]
    if not done:
        if schema is None:
            raise FileNotFoundError(root)
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{root}/snapshot={done[-1]}")


def write_jobs(jobs: DataFrame, root: str, number: int | None = None) -> str:
    """Jobs by lifecycle state, newest first within files, so searches skip row groups."""
    return write_snapshot(jobs, root, number, ("collection_state",), ("posted_at",))


def write_observations(observations: DataFrame, root: str, number: int | None = None) -> str:
    return write_snapshot(observations, root, number, ("observation_state",), ("job_id",))


def write_runs(runs: DataFrame, root: str, number: int | None = None) -> str:
    return write_snapshot(runs, root, number)


def write_days(rows: DataFrame, root: str, ts: str, closed: str | None = None) -> None:
    """A table by day of ``ts``, what may go (``closed``, an SQL condition) apart from what stays."""
    parts = rows.withColumn("closed", F.coalesce(F.expr(closed or "true"), F.lit(False))).withColumn("day", F.to_date(ts))
    parts.repartition("closed", "day").write.mode("append").partitionBy("closed", "day").parquet(root)


def retain_days(spark: SparkSession, root: str, ts: str, until: dt.datetime) -> dict[str, list[str]]:
    """Take closed rows older than ``until`` out of a table of `write_days`.

    Days that end before go as whole folders; only the day of ``until`` itself is written anew, and no
    file of any other day is touched. Tells which days were dropped and which rewritten.
    """
    fs, path = _fs(spark, root)
    done: dict[str, list[str]] = {"dropped": [], "rewritten": []}
    folder = f"{root}/closed=true"
    if not fs.exists(path(folder)):
        return done
    boundary = until.date().isoformat()
    for status in fs.listStatus(path(folder)):
        name = status.getPath().getName()
        if name.startswith("day=2") and name[4:] < boundary:
            fs.delete(status.getPath(), True)
            done["dropped"].append(name[4:])
    if fs.exists(path(f"{folder}/day={boundary}")):
        rows = spark.read.option("basePath", root).parquet(f"{folder}/day={boundary}")
        kept = cut(rows.where(F.col(ts) >= F.lit(until)), "boundary-day")
        if kept.isEmpty():
            fs.delete(path(f"{folder}/day={boundary}"), True)
        else:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("closed", "day").parquet(root)
        done["rewritten"].append(boundary)
    return done


def seed_load(jobs: DataFrame, rows: DataFrame, as_of: dt.date) -> DataFrame:
    """Insert or replace demonstration rows by id.

    ``rows`` has columns of the jobs table, with ``deadline_offset`` and ``posted_offset`` (days
    from ``as_of``) for the dates and ``load_no`` for the order; the last row of an id stays.
    """
    day = F.lit(as_of)
    values = [c for c in rows.columns if c not in ("id", "load_no")]
    last = rows.groupBy("id").agg(F.max_by(F.struct(*values), "load_no").alias("r")).select("id", "r.*")
    made = last.withColumns(
        {
            "deadline": F.date_add(day, F.col("deadline_offset").cast("int")),
            "posted_at": F.date_add(day, F.col("posted_offset").cast("int")),
            "is_demo": F.lit(True),
            "is_active": F.lit(True),
            "origin_type": F.lit("seed"),
            "collection_state": F.lit("active"),
        }
    )
    loaded = made.select(
        *[
            F.col(c).cast(jobs.schema[c].dataType).alias(c) if c in made.columns
            else F.lit(None).cast(jobs.schema[c].dataType).alias(c)
            for c in jobs.columns
        ]
    )
    return jobs.join(loaded.select("id"), "id", "left_anti").unionByName(loaded)


def sample_postings(templates: DataFrame, as_of: dt.date) -> DataFrame:
    """Sample postings from ``templates(template_no, deadline_offset, posted_offset, ...)``.

    Ids and addresses follow from the template's number, dates from the day given.
    """
    day = F.lit(as_of)
    made = templates.withColumns(
        {
            "id": F.concat(F.lit("job-"), F.lpad(F.col("template_no").cast("string"), 3, "0")),
            "deadline": F.date_add(day, F.col("deadline_offset").cast("int")),
            "posted_at": F.date_add(day, F.col("posted_offset").cast("int")),
        }
    )
    return made.withColumns(
        {
            "apply_url": F.concat(F.lit("https://example.com/apply/"), "id"),
            "source_url": F.concat(F.lit("https://example.com/source/"), "id"),
            "created_at": F.col("posted_at").cast("timestamp") + F.expr("INTERVAL 10 HOURS"),
            "source_language": F.lit("en"),
            "official_source": F.lit(False),
            "source_count": F.lit(1),
            "is_demo": F.lit(True),
        }
    ).drop("template_no", "deadline_offset", "posted_offset")


def backfill_language(jobs: DataFrame) -> DataFrame:
    """Derive the language code and the original text of collected rows."""
    own = F.col("origin_type") == "collected"
    code = F.when(F.lower(F.trim("language")) == "english", "en").otherwise("unknown")
    return jobs.withColumns(
        {
            "source_language": F.when(own, code).otherwise(F.col("source_language")),
            "original_title": F.when(own, F.col("title")).otherwise(F.col("original_title")),
            "original_description": F.when(own, F.col("description")).otherwise(F.col("original_description")),
        }
    )


def backfill_observations(jobs: DataFrame, observations: DataFrame) -> DataFrame:
    """Add one primary observation per collected row that has none under its key yet."""
    url = F.coalesce("source_url", "canonical_url")
    made = jobs.where(
        (F.col("origin_type") == "collected")
        & ~F.col("is_demo")
        & F.col("source_key").isNotNull()
        & F.col("source_item_id").isNotNull()
        & url.isNotNull()
    ).select(
        F.concat(F.lit("observation-"), "id").alias("id"),
        F.col("id").alias("job_id"),
        "source_key",
        F.coalesce("source_name", "source_key").alias("source_name"),
        "source_type",
        "source_item_id",
        url.alias("source_url"),
        "apply_url",
        F.coalesce("source_language", F.lit("unknown")).alias("source_language"),
        F.col("title").alias("observed_title"),
        F.coalesce("content_hash", "id").alias("content_hash"),
        F.coalesce("first_seen_at", "created_at").alias("first_seen_at"),
        F.coalesce("last_seen_at", "updated_at").alias("last_seen_at"),
        F.coalesce("last_verified_at", "updated_at").alias("last_verified_at"),
        F.lit(True).alias("is_primary"),
        F.col("collection_state").alias("observation_state"),
        "created_at",
        "updated_at",
    )
    fresh = made.join(observations, ["source_key", "source_item_id"], "left_anti")
    return observations.unionByName(fresh.select(*observations.columns))


def copy_runs(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Runs under a new column list: known columns copied, new ones NULL."""
    return runs.select(
        *[F.col(c) if c in runs.columns else F.lit(None).cast("string").alias(c) for c in columns]
    )


def jobs_list(jobs: DataFrame) -> DataFrame:
    """Operator listing, newest first."""
    return jobs.select("id", "title", "country", "deadline", "is_demo").orderBy(
        F.desc(jobs["posted_at"]), F.desc("id")
    )
