"""Score tables, score files, the audit trail and cost tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalgrid import schemas
from evalgrid.sources import files

_STORE_KEYS = ("run_id", "model")
#: The model in the name of its score file.
_STEM = r"^(.*)\.json$"


def _placed(*keys: str) -> Column:
    return (F.row_number().over(Window.partitionBy(*keys).orderBy("position")) - 1).cast("bigint")


def _loose_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of loose score files; one task reads a file in order."""
    read = spark.read.schema(schemas.ddl(schemas.SCORE_FILE)).option("multiLine", True).json(path)
    stem = F.regexp_extract(F.url_decode("_metadata.file_name"), _STEM, 1).alias("model")
    rows = read.select(stem, *schemas.SCORE_FILE, F.monotonically_increasing_id().alias("position"))
    return rows.withColumn("position", _placed("model"))


def _packed_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of score files in a pack; an unreadable file is one row of nulls, as it is when loose."""
    row = f"struct<{schemas.ddl(schemas.SCORE_FILE)}>"
    rows = F.coalesce(F.from_json("value", f"array<{row}>"), F.array(F.lit(None).cast(row)))
    whole = files.read_packed(spark, path).select(
        F.regexp_extract("name", _STEM, 1).alias("model"), F.posexplode(rows).alias("position", "__row")
    )
    return whole.select("model", *[F.col(f"__row.{c}") for c in schemas.SCORE_FILE], F.col("position").cast("bigint"))


def read_score_files(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Per-model JSON score files, loose or in a pack; the file stem is the model.

    ``position`` is a row's place in its file; ``generation`` counts the
    repeats of a check in that order.
    """
    rows = _packed_rows(spark, path) if files.is_packed(spark, path) else _loose_rows(spark, path)
    placed = rows.withColumn("generation", _placed("model", "item", "dimension", "sub"))
    return placed.select(F.lit(run_id).alias("run_id"), "model", *schemas.SCORE_FILE, "position", "generation")


def write_score_files(scores: DataFrame, path: str, order: list[str], packed: bool = False) -> None:
    """Scores as JSON files, a list per model with its rows in ``order``, in a pack if ``packed``."""
    fields = F.struct(*schemas.SCORE_FILE)
    rows = scores.select("model", F.struct(*order, fields.alias("__row")).alias("__placed"))
    listed = F.transform(F.sort_array(F.collect_list("__placed")), lambda p: F.to_json(p["__row"]))
    text = F.concat(F.lit("[\n"), F.array_join(listed, ",\n"), F.lit("\n]"))
    named = rows.groupBy("model").agg(text.alias("value")).withColumn("name", F.concat("model", F.lit(".json")))
    (files.write_packed if packed else files.write_named)(named, path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Store scores, replacing exactly the runs and models they cover.

    Rows are gathered by run and model first, so each folder gets few files;
    the rebalance splits a large one over several tasks.
    """
    (
        scores.hint("rebalance", *_STORE_KEYS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*_STORE_KEYS)
        .parquet(path)
    )


def read_scores(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Stored scores; a run id prunes to its folder."""
    read = spark.read.schema(schemas.ddl(schemas.SCORES)).parquet(path)
    return read if run_id is None else read.filter(F.col("run_id") == run_id)


def write_audit_trail(scores: DataFrame, path: str) -> None:
    """Every graded row as CSV, ``correct`` as 0 or 1."""
    rows = scores.select("model", "item", "dimension", "sub", F.col("correct").cast("int").alias("correct"), "weight")
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_costs(costs: DataFrame, path: str) -> None:
    """Cost sums, replaced per run and model."""
    (
        costs.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*_STORE_KEYS)
        .parquet(path)
    )
