"""Publication gates. Each returns the offending rows; none means it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.schemas import AUDIT_ACTIONS, AUDIT_FLAGS
from evalgrid.session import scratch_path

# Finish reasons that mean an answer was cut off.
TRUNCATED_REASONS = ("length", "max_tokens", "max_output_tokens")


class GateError(ValueError):
    """A gate found offending rows."""


def must_be_empty(offenders: DataFrame, message: str) -> None:
    """Raise when a gate has offending rows; all of them are written first.

    The error names their number, where the whole list is, and the first few.
    """
    if offenders.isEmpty():
        return
    path = scratch_path(offenders.sparkSession, "offenders")
    offenders.write.parquet(path)
    listed = offenders.sparkSession.read.parquet(path)
    first = "; ".join(str(row.asDict()) for row in listed.take(5))
    raise GateError(f"{message}: {listed.count()} rows, listed in {path}, such as {first}")


def duplicate_ids(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def inconsistent_metadata(scores: DataFrame) -> DataFrame:
    """Checks whose dimension or weight is not the same in every row."""
    return metadata_spread(scores).filter(
        (F.col("min_dimension") != F.col("max_dimension"))
        | (F.abs(F.col("max_weight") - F.col("min_weight")) > 1e-8 + 1e-5 * F.abs("max_weight"))
    )


def metadata_spread(scores: DataFrame) -> DataFrame:
    """Smallest and largest dimension and weight of every check.

    The few distinct combinations are found first, by hashing; only they are
    sorted for their extremes.
    """
    return scores.select("item", "sub", "dimension", "weight").distinct().groupBy("item", "sub").agg(
        F.min("dimension").alias("min_dimension"),
        F.max("dimension").alias("max_dimension"),
        F.min("weight").alias("min_weight"),
        F.max("weight").alias("max_weight"),
    )


def item_dimensions(scores: DataFrame) -> DataFrame:
    """Items found in more than one dimension; a cluster must have one."""
    return (
        scores.groupBy("item")
        .agg(F.min("dimension").alias("first"), F.max("dimension").alias("last"))
        .filter("first <> last")
    )


def models_in_several_runs(scores: DataFrame) -> DataFrame:
    """Models measured in more than one run, so that merging is ambiguous."""
    return (
        scores.select("model", "run_id")
        .distinct()
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("n_runs"),
            F.min("run_id").alias("first_run"),
            F.max("run_id").alias("last_run"),
        )
        .filter("n_runs > 1")
    )


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose number differs between two tables, with the signed excess.

    One shuffle of pre-summed counts, instead of two multiset subtractions.
    """
    signed = left.select(*columns, F.lit(1).alias("__side")).unionByName(
        right.select(*columns, F.lit(-1).alias("__side"))
    )
    return signed.groupBy(*columns).agg(F.sum("__side").alias("excess")).filter("excess <> 0")


def truncated(traces: DataFrame, reasons: tuple[str, ...] = TRUNCATED_REASONS) -> DataFrame:
    """Answers a length limit cut off."""
    return traces.filter(F.lower("finish_reason").isin(*reasons))


def missing_from(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``df`` that ``known`` does not list."""
    return df.select(key).distinct().join(known.select(key), key, "left_anti")


def judgment_errors(records: DataFrame) -> DataFrame:
    """Add ``errors``: what is wrong with each judge record, in field order.

    Absent fields and nulls are the same thing in a table; a required field
    that is null counts as missing.
    """
    required = ("item", "dimension", "sub", "graded_model", "judge_model",
                "recommended_action", "rationale", "audit_id")
    problems = [F.when(F.col(f).isNull(), F.lit(f"missing {f}")) for f in required]
    problems += [F.when(F.col(f).isNull(), F.lit(f"{f} must be boolean")) for f in AUDIT_FLAGS]
    action = F.col("recommended_action")
    problems.append(
        F.when(~F.coalesce(action.isin(*AUDIT_ACTIONS), F.lit(False)), "recommended_action invalid")
    )
    silent = F.coalesce(F.col("rationale"), F.lit("")) == ""
    problems.append(
        F.when((F.coalesce(action, F.lit("")) != "keep") & silent, "non-keep action requires rationale")
    )
    return records.withColumn("errors", F.array_compact(F.array(*problems)))


def subset_row(new: DataFrame, prior: DataFrame, key: str = "model") -> DataFrame:
    """One row ``subset``: whether ``new`` is non-empty and a strict subset of ``prior``.

    Both sides are tagged and meet in one grouping. Null keys equal each other.
    """
    tagged = new.select(key, F.lit(1).alias("__side")).unionByName(prior.select(key, F.lit(2).alias("__side")))
    sides = tagged.groupBy(key).agg(F.bit_or("__side").alias("__sides"))
    seen = [F.count_if(F.col("__sides") == n) for n in (1, 2, 3)]
    return sides.agg(((seen[0] == 0) & (seen[1] > 0) & (seen[2] > 0)).alias("subset"))


def strict_subset(new: DataFrame, prior: DataFrame, key: str = "model") -> bool:
    """Whether ``new`` is non-empty and lists a strict subset of ``prior``."""
    return subset_row(new, prior, key).collect()[0]["subset"]
