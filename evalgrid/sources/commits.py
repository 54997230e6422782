"""A run history in numbered versions that readers and writers share.

Rows are written aside, in a folder of their own, before anybody can see them.
What makes them count is a small record with the next number, which only one
writer can create; it says for each run which folder holds it. Readers follow
the last record, or an earlier one. A writer lost half-way leaves a folder
that no record names, and one that comes second judges its change again on
what the first one left.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.operators import gates
from evalgrid.sources import files


class Version(NamedTuple):
    """A version of the history: its number, 0 for none, and where its runs are."""

    number: int
    folders: dict[str, str]
    written: dict[str, int]


class History:
    """The history below ``path``, rows of ``schema`` with a ``run_id`` (never null)."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self._records = os.path.join(path, "commits")

    def version(self, number: int | None = None) -> Version:
        """The last version, or the one with that number."""
        if number is None:
            known = [n for n in files.names(self.spark, self._records) if n.endswith(".json") and n[0] != "."]
            number = int(known[-1][:-5]) if known else 0
        if number == 0:
            return Version(0, {}, {})
        record = json.loads(files.read_text(self.spark, self._record(number)))
        return Version(number, record["folders"], record["written"])

    def _record(self, number: int) -> str:
        return os.path.join(self._records, f"{number:012d}.json")

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of a version, and ``commit``, the version that wrote them."""
        return self._rows(self.version(number))

    def _rows(self, version: Version) -> DataFrame:
        rows = self.spark.createDataFrame([], self.schema).withColumn("commit", F.lit(0))
        if not version.folders:
            return rows
        where = [(folder, run, version.written[run]) for run, folder in version.folders.items()]
        live = self.spark.createDataFrame(where, "folder string, run_id string, commit int")
        data = os.path.join(self.path, "data")
        read = self.spark.read.option("basePath", data).schema(f"{self.schema}, folder string")
        held = read.parquet(*[os.path.join(data, f"folder={f}") for f in sorted(set(version.folders.values()))])
        # partition values only, so folders of replaced runs are never opened
        counts = F.concat_ws("/", "folder", "run_id").isin([f"{folder}/{run}" for folder, run, _ in where])
        return held.filter(counts).join(live, ["folder", "run_id"]).select(*rows.columns)

    def commit(self, change: Callable[[DataFrame], DataFrame], attempts: int = 20) -> Version:
        """Put the rows that ``change`` makes of the last version in place of their runs.

        ``change`` refuses by raising; then the history stays as it is. It is asked
        again whenever another writer was first. A change without rows makes
        no version.
        """
        for _ in range(attempts):
            base = self.version()
            rows = change(self._rows(base).drop("commit"))
            folder, number = uuid.uuid4().hex, base.number + 1
            place = os.path.join(self.path, "data", f"folder={folder}")
            rows.select(*self.spark.createDataFrame([], self.schema).columns).hint("rebalance", "run_id").write.partitionBy("run_id").parquet(place)
            runs = [r["run_id"] for r in self._runs(place).collect()]  # the registry of runs, which every record lists
            if not runs:
                return base
            if None in runs:
                raise gates.GateError("rows without a run id")
            record = {
                "folders": {**base.folders, **dict.fromkeys(runs, folder)},
                "written": {**base.written, **dict.fromkeys(runs, number)},
            }
            if files.claim(self.spark, self._record(number), json.dumps(record)):
                return Version(number, record["folders"], record["written"])
        raise gates.GateError(f"{attempts} times another writer was first")

    def _runs(self, place: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(place).select("run_id").distinct()

    def orphans(self) -> list[str]:
        """Folders that no version names: of writers at work, lost or too late."""
        named: set[str] = set()
        for number in range(1, self.version().number + 1):
            named |= set(self.version(number).folders.values())
        folders = (n.partition("=")[2] for n in files.names(self.spark, os.path.join(self.path, "data")))
        return [f for f in folders if f and f not in named]
