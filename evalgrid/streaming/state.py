"""The last answer and the last call of every turn, kept as a stream's state.

The log of taken-in lines only grows. A second stream follows it and keeps one
row per turn in a RocksDB state store, so what counts now is read from the
state and costs what the turns hold, not what was ever delivered. The greatest
line wins by ``ingest.ORDER``: late lines lose, repeated ones change nothing,
and a stream started again goes on where its checkpoint ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid import schemas
from evalgrid.operators import grade, requests
from evalgrid.session import cut
from evalgrid.streaming.ingest import CALL, ORDER, TURN

_STORE = "spark.sql.streaming.stateStore"
_ON_DISK = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _disk_state(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in _ON_DISK}
    for key, value in _ON_DISK.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class TurnState:
    """Follows the log at ``log_path``; ``checkpoint`` lies in a shared folder."""

    def __init__(self, spark: SparkSession, log_path: str, checkpoint: str):
        self.spark, self.log_path, self.checkpoint = spark, log_path, checkpoint

    def follow(self, max_files: int = 1000) -> None:
        """Take in what was logged since the last time.

        The log is written before it is followed, never at the same time: a
        batch that is taken in again replaces its folder.
        """
        log = (
            self.spark.readStream.schema(schemas.ddl(schemas.RESULT_LOG))
            .option("maxFilesPerTrigger", max_files)
            .parquet(self.log_path)
            .filter("outcome in ('merged', 'error')")
        )
        order = F.struct(*ORDER)
        answer = F.when(F.col("outcome") == "merged", F.struct(order.alias("at"), "text"))
        turns = log.groupBy(*TURN).agg(
            F.max(answer).alias("answer"),
            F.max_by(F.struct(*CALL), order).alias("call"),
            F.count(F.lit(1)).alias("n_calls"),
        )
        with _disk_state(self.spark):
            (
                turns.writeStream.format("noop")
                .outputMode("update")
                .option("checkpointLocation", self.checkpoint)
                .trigger(availableNow=True)
                .start()
                .awaitTermination()
            )

    def turns(self) -> DataFrame:
        """One row per called turn: ``answer`` (null if none came), the fields of its last call, ``n_calls``.

        ``n_calls`` counts lines, repeated ones too.
        """
        with _disk_state(self.spark):
            state = self.spark.read.format("statestore").load(self.checkpoint)
            # the stored fields come in the order of the aggregates: answer, call, the call's order, count
            answer, call, _, calls = (F.col(f"value.`{field}`") for field in state.schema["value"].dataType.names)
            found = state.select(
                *[F.col(f"key.{name}").alias(name) for name in TURN],
                answer["text"].alias("answer"),
                *[call[name].alias(name) for name in CALL],
                calls.alias("n_calls"),
            )
            return cut(found)

    def responses(self, padded: bool = False) -> DataFrame:
        """The last answer to every turn, as ``ingest.current_responses`` has it."""
        answers = self.turns().filter("answer is not null").select(*TURN, F.col("answer").alias("text"))
        return requests.pad_generations(answers) if padded else answers

    def traces(self) -> DataFrame:
        """The last call of every turn, as ``ingest.current_traces`` has it."""
        return grade.parse_status(self.turns().select(*TURN, *CALL))
