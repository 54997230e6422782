"""Judge lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "")


def write_lines(records: DataFrame, path: str) -> None:
    """One JSON object per line, keys in name order, nulls kept."""
    ordered = F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"})
    records.select(ordered.alias("value")).write.mode("overwrite").text(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_requests(payloads: DataFrame, path: str, judge_model: str, instructions: str, max_output_tokens: int = 700) -> None:
    """One judge request per line, its payload as JSON text."""
    payload = F.to_json(F.struct(*sorted(payloads.columns)), {"ignoreNullFields": "false"})
    body = F.struct(
        F.lit(instructions).alias("instructions"),
        payload.alias("input"),
        F.lit(max_output_tokens).alias("max_output_tokens"),
        F.lit(judge_model).alias("model"),
    )
    line = F.to_json(F.struct(body.alias("body"), F.col("audit_id").alias("custom_id")))
    payloads.select(line.alias("value")).write.mode("overwrite").text(path)
