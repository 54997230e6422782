"""Cases, keys and the model registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid import schemas
from evalgrid.functions import ids


def read_documents(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """JSON documents below a folder, one per file, those without id left out.

    ``_path`` keeps where a document came from; fields that start with an
    underscore never enter a fingerprint.
    """
    read = spark.read.schema(schemas.ddl(columns)).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return read.filter(F.col("id").isNotNull()).select("*", F.col("_metadata.file_path").alias("_path"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, schemas.CASES)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, schemas.KEYS)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """The model registry, one JSON object per line."""
    return with_meta(spark.read.schema(schemas.ddl(schemas.MODELS)).json(path))


def with_meta(models: DataFrame) -> DataFrame:
    """Fill a missing label from the name and a missing date from the id."""
    return models.withColumn("label", F.coalesce("label", "name")).withColumn(
        "released", F.coalesce(F.col("released").cast("string"), ids.released_from_id(F.col("id")))
    )
