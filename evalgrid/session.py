"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def build_session(app: str = "evalgrid", **settings: str) -> SparkSession:
    """A session with the settings the library relies on; the cluster's win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")  # the last of repeated keys counts
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for cut lineage and written tables.

    Only a local session with nothing configured gets a temporary folder: on a
    cluster a machine-local path would not be visible to the executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="spark-evalgrid-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, never reused between runs."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used after an aggregation has reduced the input to a table that many later
    steps read: the big scan runs once, a lost executor re-reads the result
    from shared storage, and Catalyst knows the size and prunes the columns of
    what it reads.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(spark: SparkSession) -> int:
    """How many shuffle partitions the session is set to use."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
