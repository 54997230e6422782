"""Token and cost sums, and the settings a run was made with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Request parameters a run must not set, and the names a token
# ceiling goes by with the places it is looked for.
FORBIDDEN = (
    '"(temperature|top_p|top_k|reasoning|reasoning_effort|thinking'
    '|thinkingConfig|thinking_config|budget_tokens|effort)"'
)
CEILINGS = ("max_tokens", "max_output_tokens", "max_completion_tokens")
CEILING_PLACES = ("$.{0}", "$.body.{0}", "$.params.{0}", "$.request.{0}", "$.request.generation_config.{0}",
                  "$.body.generation_config.{0}")


def cost_summary(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Requests, tokens and cost; cost is null only if every row's is.

    Costs carry eight decimals, so they are summed as decimals: the total does
    not depend on the order of the rows.
    """
    def tokens(name: str) -> Column:
        return F.coalesce(F.sum(f"usage.{name}"), F.lit(0)).alias(name)

    return traces.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        tokens("input_tokens"),
        tokens("output_tokens"),
        tokens("total_tokens"),
        tokens("cached_input_tokens"),
        F.round(F.sum(F.col("cost_usd").cast("decimal(28,8)")), 6).cast("double").alias("estimated_cost_usd"),
    )


def with_forbidden(requests: DataFrame, text: str = "value") -> DataFrame:
    """Add the first forbidden parameter found in each request's text."""
    return requests.withColumn(
        "forbidden", F.nullif(F.regexp_extract(text, FORBIDDEN, 1), F.lit(""))
    )


def find_value(document: Column, text: Column, name: str) -> Column:
    """The value of a key in a request: known places first, then anywhere."""
    known = [F.try_variant_get(document, place.format(name), "string") for place in CEILING_PLACES]
    anywhere = F.nullif(F.regexp_extract(text, f'"{name}"\\s*:\\s*"?([^",}}\\s]+)', 1), F.lit(""))
    return F.coalesce(*known, anywhere)


def ceilings(requests: DataFrame, text: str = "value") -> DataFrame:
    """How many requests of each model set which token ceiling."""
    parsed = requests.withColumn("__doc", F.try_parse_json(text))
    pairs = F.array(
        *[F.struct(F.lit(c).alias("key"), find_value(F.col("__doc"), F.col(text), c).alias("value")) for c in CEILINGS]
    )
    each = parsed.select("model", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p"))
    return each.groupBy("model", F.col("p.key").alias("key"), F.col("p.value").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )


def run_modes(traces: DataFrame) -> DataFrame:
    """Calls per run mode and whether a model mixed modes."""
    return traces.filter(F.col("run_mode").isNotNull()).groupBy("model").agg(
        F.count_if(F.col("run_mode") == "live").alias("n_live"),
        F.count_if(F.col("run_mode") == "batch").alias("n_batch"),
        (F.countDistinct("run_mode") > 1).alias("mixed_modes"),
    )
