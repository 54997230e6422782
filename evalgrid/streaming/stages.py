"""A run of staged batches: ask what is open, take in what comes back, ask on.

A multi-turn item can only be asked its next question when the one before has
an answer, so a run is a loop of stages. All it knows lies in folders below
one base: the manifests of all stages, the delivered lines, their log, and the
state of every turn. A run that was lost goes on from there in a new session.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid import schemas
from evalgrid.operators import requests
from evalgrid.sources import batch_files, files
from evalgrid.streaming import ingest
from evalgrid.streaming.state import TurnState

_ASKED = {**schemas.MANIFEST, "messages": "array<struct<role:string,content:string>>", "max_tokens": "int"}


class StagedRun:
    """One run of ``models`` on ``cases``, kept below ``base`` in a shared folder.

    ``models`` and ``cases`` are as the bank readers give them; every batch
    model owes every item ``generations`` answers. ``deliveries`` is where
    result files are put, by anybody and at any time.
    """

    def __init__(
        self, spark: SparkSession, base: str, models: DataFrame, cases: DataFrame, generations: int, run_id: str,
        max_tokens: int = 2048, system: str | None = None,
    ):
        self.spark, self.models, self.cases = spark, models, cases
        self.generations, self.run_id, self.max_tokens, self.system = generations, run_id, max_tokens, system
        self._manifest, self.deliveries, self._log = (os.path.join(base, n) for n in ("manifest", "lines", "log"))
        self._checkpoint = os.path.join(base, "checkpoint")
        self.state = TurnState(spark, self._log, os.path.join(base, "state"))

    def asked(self) -> DataFrame:
        """The requests of all stages."""
        if not files.exists(self.spark, self._manifest):
            return self.spark.createDataFrame([], schemas.ddl(_ASKED))
        return self.spark.read.schema(schemas.ddl(_ASKED)).parquet(self._manifest)

    def answers(self) -> DataFrame:
        """The last answer to every turn; none before the first delivery."""
        if not files.exists(self.spark, self.state.checkpoint):
            return self.spark.createDataFrame([], schemas.ddl(schemas.RESPONSES))
        return self.state.responses()

    def ask(self) -> DataFrame:
        """Write and return the next stage: the first open turn of every thread.

        A model's stage is one more than its last. Empty when all is answered.
        Asking twice without a delivery between asks the same turns again, in
        a further stage, as after a failed call.
        """
        made = requests.stage_requests(
            self.models, self.cases, self.answers(), self.generations, self.run_id, self.asked(),
            self.max_tokens, self.system,
        )
        batch_files.write_manifest(made, self._manifest)
        return made

    def take_in(self) -> None:
        """Log the files delivered since the last time and bring the state up to date."""
        ingest.ingest_results(
            self.spark, self.deliveries, self.asked(), self._log, self._checkpoint
        ).awaitTermination()
        self.state.follow()

    def settle(self, send: Callable[[DataFrame, str], None]) -> None:
        """Ask, send and take in until nothing is open or a stage answers nothing.

        ``send`` is given a stage's requests and the folder for its result lines.
        """
        answered = self._answered()
        while True:
            stage = self.ask()
            if stage.isEmpty():
                return
            send(stage, self.deliveries)
            self.take_in()
            before, answered = answered, self._answered()
            if answered <= before:
                return

    def _answered(self) -> int:
        return self.answers().filter(F.length("text") > 0).count()
