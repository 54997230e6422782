"""Request files, manifests and result files of staged batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_requests(requests: DataFrame, path: str) -> None:
    """One JSON request per line, a folder per model and stage."""
    body = F.to_json(
        F.struct("custom_id", F.struct(F.col("model_id").alias("model"), "messages", "max_tokens").alias("body"))
    )
    (
        requests.select("model", "stage", body.alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model", "stage")
        .text(path)
    )


def write_manifest(requests: DataFrame, path: str) -> None:
    """What was asked, with the time it was written."""
    (
        requests.withColumn("created_at", F.current_timestamp())
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model", "stage")
        .parquet(path)
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_result_lines(spark: SparkSession, results: str, errors: str | None = None) -> DataFrame:
    """Result lines of a batch and its optional error file, blanks left out."""
    return spark.read.text([results, errors] if errors else [results]).filter(F.trim("value") != "")


def read_request_lines(spark: SparkSession, path: str) -> DataFrame:
    """Archived request lines with the model their folder names."""
    return spark.read.text(path).filter(F.trim("value") != "").select("model", "value")
