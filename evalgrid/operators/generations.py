"""Which models have been superseded, and by how much."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.functions import lineage, verdicts
from evalgrid.operators import pairs


def with_lineage(models: DataFrame, label: str = "label") -> DataFrame:
    """Add ``family`` and ``version`` read from the label."""
    return models.withColumn("family", lineage.family_of(F.col(label))).withColumn(
        "version", lineage.version_of(F.col(label))
    )


def successions(board: DataFrame) -> DataFrame:
    """(model, successor) for every superseded model of a board.

    A declared successor wins; otherwise it is the newest ranked model of the
    same family, if newer. Only ranked models count as successors. The newest
    of a family is one aggregate, so families are never joined to themselves.
    """
    models = with_lineage(
        board.filter(~F.col("is_baseline")).withColumn("__label", F.coalesce("label", "model")), "__label"
    )
    ranked = models.filter("ranked_eligible")
    newest = (
        ranked.filter(F.col("version").isNotNull())
        .groupBy("family")
        .agg(F.max(F.struct("version", "model")).alias("newest"))
    )
    names = ranked.select(F.col("model").alias("superseded_by"), F.lit(True).alias("__declared"))
    joined = models.join(newest, "family", "left").join(
        names, "superseded_by", "left"
    )
    inferred = F.when(F.col("newest.version") > F.col("version"), F.col("newest.model"))
    declared = F.when(F.col("__declared") & (F.col("superseded_by") != F.col("model")), F.col("superseded_by"))
    return joined.select("model", F.coalesce(declared, inferred).alias("successor")).filter(
        F.col("successor").isNotNull()
    )


def split(board: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, previous) models of a board."""
    gone = successions(board).select("model")
    return board.join(gone, "model", "left_anti"), board.join(gone, "model", "left_semi")


def succession_pairs(board: DataFrame, records: DataFrame) -> DataFrame:
    """Each succession with its paired comparison, successor minus predecessor.

    ``records`` are published pair records in either orientation; differences
    come back in score points.
    """
    oriented = pairs.both_views(records, "delta").select(
        F.col("model").alias("curr"), F.col("opponent").alias("prev"), "delta", "lo", "hi", "winner"
    )
    both = records.select(F.col("a").alias("curr"), F.col("b").alias("prev"), "holm_p").unionByName(
        records.select(F.col("b").alias("curr"), F.col("a").alias("prev"), "holm_p")
    )
    found = successions(board).select(F.col("model").alias("prev"), F.col("successor").alias("curr"))
    joined = found.join(oriented, ["curr", "prev"], "left").join(both, ["curr", "prev"], "left")
    delta, lo, hi = F.col("delta"), F.col("lo"), F.col("hi")
    decisive = F.col("winner").isNotNull()
    side = verdicts.generation_winner(delta, lo, hi, F.col("winner"), F.col("prev"), F.col("curr"))
    suggestive = ~decisive & F.coalesce(pairs.excludes_zero(lo, hi), F.lit(False))
    marked = joined.select(
        "prev", "curr",
        (delta * 100).alias("delta"), (lo * 100).alias("lo"), (hi * 100).alias("hi"), "holm_p",
        side.alias("winner"), decisive.alias("decisive"), suggestive.alias("suggestive"),
    )
    d, w = F.col("delta"), F.col("winner")
    return (
        marked.withColumn("verdict", verdicts.verdict_text(d, w, F.col("decisive")))
        .withColumn("confidence", verdicts.confidence_text(d, w, F.col("decisive"), F.col("suggestive")))
        .orderBy(F.desc_nulls_last("delta"), "prev")
    )
