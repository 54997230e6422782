"""Plans from atomic scores to boards and pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid import DIMENSIONS
from evalgrid.functions import verdicts
from evalgrid.operators import aggregate, checks, coverage, gates, grade, pairs, rank, resample, scope
from evalgrid.session import cut

MODEL = ["model"]


def point_board(scores: DataFrame) -> DataFrame:
    """Headline score and position of every model."""
    sums = aggregate.dimension_scores(aggregate.check_sums(scores, MODEL), MODEL)
    board = rank.positions(aggregate.headline(sums, MODEL))
    return board.withColumn("is_baseline", scope.is_baseline(F.col("model")))


def summary(
    sums: DataFrame, n: int = resample.HEADLINE_DRAWS, n_dimension: int = resample.DIMENSION_DRAWS, seed: int = 0
) -> DataFrame:
    """Value and interval of the headline and of every dimension per model.

    One set of resamples serves all four intervals.
    """
    clusters = cut(aggregate.cluster_sums(sums, MODEL))
    values = aggregate.dimension_scores(clusters, MODEL)
    wide = values.groupBy(*MODEL).pivot("dimension", list(DIMENSIONS)).agg(F.first("value"))
    points = aggregate.headline(values, MODEL)
    spread = resample.all_intervals(clusters, MODEL, DIMENSIONS, n, n_dimension, seed)
    return (
        points.join(wide, MODEL)
        .join(spread, MODEL)
        .select(
            *MODEL,
            "score",
            (F.col("score_lo") * 100).alias("lo"),
            (F.col("score_hi") * 100).alias("hi"),
            *[f"{d}{end}" for d in DIMENSIONS for end in ("", "_lo", "_hi")],
        )
    )


def snapshot(scores: DataFrame, expected: DataFrame, models: DataFrame, n: int = resample.HEADLINE_DRAWS) -> DataFrame:
    """The full board of a run: intervals, coverage, metadata, bands."""
    sums = cut(aggregate.check_sums(scores, MODEL))
    covered = coverage.coverage_board(sums, expected, MODEL)
    meta = models.select(
        F.col("name").alias("model"), F.coalesce("label", "name").alias("label"), "provider", "price_in",
        "price_out", "superseded_by",
    )
    values = ("score", "lo", "hi"), *((d, f"{d}_lo", f"{d}_hi") for d in DIMENSIONS)
    rounded = {c: F.round(c, 4) for group in values for c in group}
    board = summary(sums, n).withColumns(rounded).join(covered, MODEL).join(meta, MODEL, "left")
    return rank.overlap_bands(board.withColumn("label", F.coalesce("label", "model")))


def stored_models(board: DataFrame, run_id: str) -> DataFrame:
    """A board in the form the run history keeps: each score with its interval."""
    scored = {"score": ("score", "lo", "hi"), **{d: (d, f"{d}_lo", f"{d}_hi") for d in DIMENSIONS}}
    triples = [verdicts.triple(*[F.col(c) for c in columns]).alias(name) for name, columns in scored.items()]
    flat = {c for columns in scored.values() for c in columns}
    return board.select(
        F.lit(run_id).alias("run_id"), *[c for c in board.columns if c not in flat], *triples
    )


def regrade(responses: DataFrame, cases: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores, skipped): saved answers under the current keys.

    Answers to items that have left the bank are not graded but counted.
    """
    checks.attach_keys(cases, keys)
    known = cases.select(F.col("id").alias("item"))
    rules = checks.checks_from_keys(keys.join(cases.select("id"), "id", "left_semi"))
    current = responses.join(known, "item", "left_semi")
    return grade.grade(current, rules), grade.skipped_items(responses, cases)


def pair_table(
    scores: DataFrame, n: int = resample.PAIR_DRAWS, permutations: int = resample.SIGN_FLIPS, seed: int = 0
) -> DataFrame:
    """All paired comparisons of the ranked models, best placed first."""
    ranked = scope.ranked_only(scores)
    means = cut(aggregate.generation_means(ranked, MODEL))
    gates.must_be_empty(
        gates.inconsistent_metadata(means).select("item", "sub"), "dimension or weight of a check changes"
    )
    per_check = means.select(
        "model", "dimension", (F.col("weight") * F.col("n_generations")).alias("den"),
        (F.col("weight") * F.col("n_generations") * F.col("rate")).alias("num"),
    )
    order = rank.positions(aggregate.headline(aggregate.dimension_scores(per_check, MODEL), MODEL))
    return cut(pairs.compare(means, order, n, permutations, seed))
