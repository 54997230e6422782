"""Merging runs and keeping their history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalgrid.functions import hashing
from evalgrid.operators import gates, scope


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Scores of several runs as one board, baselines dropped.

    A model measured in two runs is an error: neither measurement may win
    silently.
    """
    merged = scope.ranked_only(reduce(lambda a, b: a.unionByName(b), runs))
    gates.must_be_empty(gates.models_in_several_runs(merged), "model in more than one run")
    return merged


def upsert(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``new`` in place of those with their keys."""
    return target.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(
        new, allowMissingColumns=True
    )


def append_snapshot(ledger: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The run history with a run's snapshot added or replaced, in run order."""
    return upsert(ledger, snapshot, ["run_id"]).orderBy(F.coalesce("run_date", F.lit("")), "run_id")


def merge_models(
    ledger_models: DataFrame, ledger: DataFrame, target_run: str, snapshot_models: DataFrame, snapshot_bank: DataFrame
) -> DataFrame:
    """Fold a late run's models into an existing run, by model name.

    Refused for an unknown target, another bank, or a baseline among the new
    models. The target keeps its own bank, version and floor.
    """
    target = ledger.filter(F.col("run_id") == target_run)
    if target.isEmpty():
        raise gates.GateError(f"no run {target_run!r} in the ledger")
    digests = ["evaluation_hash", "content_hash", "items_hash"]
    old = target.select(F.struct(*digests).alias("old"), F.lit(target_run).alias("run_id"))
    new = snapshot_bank.select(F.struct(*digests).alias("new"), F.lit(target_run).alias("run_id"))
    other = old.join(new, "run_id").filter(~hashing.same_bank(F.col("old"), F.col("new")))
    gates.must_be_empty(other.select("run_id"), "refusing to merge: scored on another bank")
    gates.must_be_empty(
        snapshot_models.filter(scope.is_baseline(F.col("model"))).select("model"),
        "refusing to merge a baseline",
    )
    return upsert(
        ledger_models, snapshot_models.withColumn("run_id", F.lit(target_run)), ["run_id", "model"]
    )


def inherit_versions(runs: DataFrame) -> DataFrame:
    """Add the version each run takes over and whether it must declare one.

    ``runs`` has one row per run with its digests and declared ``version``. A
    run on the bank of the run before it inherits that version.
    """
    order = Window.partitionBy("scope").orderBy(F.coalesce("run_date", F.lit("")), "run_id")
    bank = F.struct("evaluation_hash", "content_hash", "items_hash")
    prior = runs.withColumn("__bank", bank).withColumn("__prior", F.lag("__bank").over(order))
    same = F.coalesce(hashing.same_bank(F.col("__bank"), F.col("__prior")), F.lit(False))
    stepped = prior.withColumn("same_bank", F.col("__prior").isNotNull() & same).withColumn(
        "must_declare", ~F.col("same_bank") & F.col("version").isNull()
    )
    era = F.sum((~F.col("same_bank")).cast("int")).over(order)
    numbered = stepped.withColumn("__era", era)
    carried = F.last("version", ignorenulls=True).over(
        Window.partitionBy("scope", "__era").orderBy(F.coalesce("run_date", F.lit("")), "run_id")
    )
    return numbered.withColumn("effective_version", carried).drop("__bank", "__prior", "__era")


def _struct_literal(row: Row) -> Column:
    return F.struct(*[F.lit(value).cast("string").alias(name) for name, value in row.asDict().items()])


def append_run(
    ledger: DataFrame, ledger_models: DataFrame, snapshot: DataFrame, snapshot_models: DataFrame,
    version: str | None = None,
) -> DataFrame:
    """Append a run under the version rules.

    Refuses a roster that is a strict subset of the latest run's, and a changed
    bank without a declared version.
    """
    last = ledger.orderBy(F.desc(F.coalesce("run_date", F.lit(""))), F.desc("run_id")).limit(1)
    newest = last.collect()
    if newest:
        prior_models = ledger_models.filter(F.col("run_id") == newest[0]["run_id"])
        if gates.strict_subset(scope.ranked_only(snapshot_models), scope.ranked_only(prior_models)):
            raise gates.GateError("roster is a subset of the last full run; merge it instead")
    if version is None:
        digests = F.struct("evaluation_hash", "content_hash", "items_hash")
        latest = last.select(digests.alias("bank"), "version").collect()
        unchanged = latest and not snapshot.filter(
            hashing.same_bank(digests, _struct_literal(latest[0]["bank"]))
        ).isEmpty()
        if not unchanged:
            raise gates.GateError("changed bank: declare a version")
        version = latest[0]["version"]
    return append_snapshot(ledger, snapshot.withColumn("version", F.lit(version)))
