"""Results that arrive in files, in any order, over time.

Every micro-batch appends its matched lines to a log, in a folder of its own
that a retry overwrites. What counts is read from the log: the last answer to
each turn. Writing costs what a batch holds, not what the table holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalgrid.operators import grade, requests

TURN = ["run_id", "model", "item", "generation", "turn_id"]
#: Later in this order wins.
ORDER = ["written_at", "batch_id", "file_time", "file_name", "block", "line"]
#: What is known of a call.
CALL = ["text", "provider", "served_model", "run_mode", "request_id", "finish_reason", "usage", "cost_usd", "error"]


def ingest_results(
    spark: SparkSession,
    lines_path: str,
    manifest: DataFrame,
    log_path: str,
    checkpoint_path: str,
    written_at: str | None = None,
    max_files: int = 1000,
) -> StreamingQuery:
    """Read every new result file once and log its lines.

    ``written_at`` is an optional JSON path of a number in a line that orders
    lines before their arrival does.
    """
    lines = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", max_files)
        .load(lines_path)
        .select(
            "value",
            F.col("_metadata.file_modification_time").alias("file_time"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    )
    stamp = F.try_variant_get(F.try_parse_json("value"), written_at, "bigint") if written_at else F.lit(None)

    def log(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumn("line", F.monotonically_increasing_id()).withColumn(
            "written_at", stamp.cast("bigint")
        )
        (
            requests.normalize_results(placed, manifest)
            .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(log_path)
        )

    return (
        lines.writeStream.foreachBatch(log)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.parquet(log_path).withColumn("batch_id", F.col("batch_id").cast("bigint"))


def _latest(log: DataFrame, columns: list[str]) -> DataFrame:
    newest = F.max_by(F.struct(*columns), F.struct(*ORDER))
    return log.groupBy(*TURN).agg(newest.alias("__row")).select(*TURN, "__row.*")


_MERGED, _CALLED = "outcome = 'merged'", "outcome in ('merged', 'error')"


def current_responses(log: DataFrame, padded: bool = False) -> DataFrame:
    """The last answer to every turn; a failed call leaves the turn open.

    ``padded`` fills the generations missing below an item's last one with
    empty answers, as saved answer files have them.
    """
    answers = _latest(log.filter(_MERGED), ["text"])
    return requests.pad_generations(answers) if padded else answers


def current_traces(log: DataFrame) -> DataFrame:
    """The last call made for every turn, failed ones included.

    ``parse_ok`` tells whether its answer holds a JSON object.
    """
    return grade.parse_status(_latest(log.filter(_CALLED), CALL))


def compact(log: DataFrame, path: str) -> None:
    """Write the lines of a log that still count to a new log at ``path``.

    These are each turn's last answer and last call, and all lines that belong
    to no turn. Whoever reads the log is pointed at the new one afterwards.
    """
    rest = [c for c in log.columns if c not in TURN]
    kept = [_latest(log.filter(which), rest).select(log.columns) for which in (_MERGED, _CALLED)]
    kept.append(log.filter(f"not ({_CALLED})"))
    both = kept[0].unionByName(kept[1]).dropDuplicates([*TURN, *ORDER])
    both.unionByName(kept[2]).write.partitionBy("batch_id").parquet(path)


def ingest_counts(log: DataFrame) -> DataFrame:
    """How many lines were merged, failed, or asked for by nobody."""
    return log.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
