"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every job relies on; all are Spark defaults or public options.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "postlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only if unset in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if root:
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(root)
        return root
    if current.isDefined():
        return current.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Bytes of a table for each core from which on its files make a task for each core by themselves.
SPLIT = 64 << 20


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later jobs start from the files, also after executors are lost, and their plans know the
    size of what they read. Scratch tables stay on disk, so they are packed tightly.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, key: str) -> DataFrame:
    """``df`` with rows of equal ``key`` in one task, or in several if they are too many for one."""
    return df.sparkSession.sql(f"SELECT /*+ REBALANCE({key}) */ * FROM {{rows}}", rows=df)


def spread(df: DataFrame, label: str = "spread") -> DataFrame:
    """Like ``cut``, with the rows dealt to all cores if the table is too small to make a task for each.

    A delivery of few files would else be worked on by as few tasks, whatever is done to its rows.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    cores = df.sparkSession.sparkContext.defaultParallelism
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).getContentSummary(folder).getLength()
    return cut(rows.repartition(cores), label) if size < cores * SPLIT else rows
