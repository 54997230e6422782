"""Weighted scores and the sums they are made of.

``check_sums`` reduces atomic rows to one row per model and check. It is the
only step that reads the atomic rows; everything after works on its output,
whose size is models times checks however many generations were graded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.operators import scope


def _passed(correct: str = "correct") -> Column:
    return F.col(correct).cast("double")


def check_sums(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and weighted sums per check; the sufficient statistics."""
    return scores.groupBy(*keys, "dimension", "item", "sub").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("correct").alias("n_correct"),
        F.sum("weight").alias("den"),
        F.sum(F.col("weight") * _passed()).alias("num"),
    )


def cluster_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted sums per item, the unit that gets resampled."""
    return sums.groupBy(*keys, "dimension", "item").agg(
        F.sum("den").alias("den"), F.sum("num").alias("num")
    )


def generation_means(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Share of generations that pass each check, with its fixed metadata.

    Dimension and weight are grouped by, so that the rows are hashed and not
    sorted; a check whose metadata changes comes out as several rows.
    """
    return scores.groupBy(*keys, "item", "sub", "dimension", "weight").agg(
        F.avg(_passed()).alias("rate"),
        F.count(F.lit(1)).alias("n_generations"),
    )


def dimension_scores(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean per dimension, from sums of any granularity."""
    return sums.groupBy(*keys, "dimension").agg(
        F.try_divide(F.sum("num"), F.sum("den")).alias("value")
    )


def headline(dimension_values: DataFrame, keys: list[str]) -> DataFrame:
    """Equal-weight mean over the dimensions present, on a 0 to 100 scale."""
    return dimension_values.groupBy(*keys).agg(
        (F.avg("value") * 100).alias("score"), F.count("value").alias("n_dimensions")
    )


def difficulty(sums: DataFrame) -> DataFrame:
    """Pass rate of every check over all models, and whether it is dead."""
    rate = F.try_divide(F.sum("n_correct"), F.sum("n"))
    return (
        sums.groupBy("item", "sub")
        .agg(rate.alias("pass_rate"), F.sum("n").alias("n"))
        .withColumn("dead", F.col("pass_rate").isin(0.0, 1.0))
    )


def live_sums(sums: DataFrame) -> DataFrame:
    """Sums of ranked models without the checks all of them pass or fail."""
    ranked = scope.ranked_only(sums)
    dead = difficulty(ranked).filter("dead").select("item", "sub")
    return ranked.join(dead, ["item", "sub"], "left_anti")
