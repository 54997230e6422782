"""The run history and published pair records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid import schemas


def write_runs(runs: DataFrame, path: str) -> None:
    """Store runs; a run id that is stored already is replaced."""
    (
        runs.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_pairs(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pair records, as files of one JSON array or of one object per line.

    A file with a line that opens a list is an array; the two kinds may be
    mixed. Each is read by the reader that suits it.
    """
    file = F.col("_metadata.file_path").alias("__file")
    arrays = spark.read.text(path).filter(F.startswith(F.ltrim("value"), F.lit("["))).select(file).distinct()
    reader = spark.read.schema(schemas.ddl(schemas.PAIRS))
    lines = reader.json(path).select("*", file).join(arrays, "__file", "left_anti")
    listed = reader.option("multiLine", True).json(path).select("*", file).join(arrays, "__file", "left_semi")
    return lines.unionByName(listed).drop("__file")
