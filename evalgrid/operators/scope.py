"""Row scopes: example items, baselines, routes, misses."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The scope names and the marks of examples and baselines.
ALL, OFFICIAL, EXAMPLES = "all", "official_real_only", "examples"
SCOPES = (ALL, OFFICIAL, EXAMPLES)
_EXAMPLE_PREFIX = "example_"
_BASELINE_MARK = "naive"


def is_example(item: Column) -> Column:
    return F.startswith(item, F.lit(_EXAMPLE_PREFIX))


def is_baseline(model: Column) -> Column:
    """Baselines bound the score from below and are never ranked."""
    return F.contains(model, F.lit(_BASELINE_MARK))


def in_scope(df: DataFrame, scope: str, item: str = "item") -> DataFrame:
    """Rows of one case scope; an unknown scope is an error."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}; expected one of {SCOPES}")
    if scope == ALL:
        return df
    example = is_example(F.col(item))
    return df.filter(example if scope == EXAMPLES else ~example)


def scopes_of(item: Column) -> Column:
    """The scopes an item belongs to, for one pass over all of them."""
    return F.array(F.lit(ALL), F.when(is_example(item), EXAMPLES).otherwise(OFFICIAL))


def ranked_only(df: DataFrame, model: str = "model") -> DataFrame:
    return df.filter(~is_baseline(F.col(model)))


def misses(scores: DataFrame) -> DataFrame:
    return scores.filter(~F.col("correct"))


def eligible_rows(board: DataFrame) -> DataFrame:
    """Rows of a banded board that hold a rank."""
    return board.filter(F.col("ranked_eligible") & F.col("rank").isNotNull())


def with_route(models: DataFrame) -> DataFrame:
    """How each model is called: local mocks, vendor batches, or directly."""
    return models.withColumn(
        "route",
        F.when(F.col("provider") == "mock", "local")
        .when(F.coalesce(F.col("batch_supported"), F.lit(False)), "batch")
        .otherwise("direct"),
    )
