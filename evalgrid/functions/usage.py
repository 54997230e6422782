"""Token usage in one shape, and what it costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where each vendor puts its counts, in order of preference.
_INPUT = ("input_tokens", "prompt_tokens", "prompt_token_count", "promptTokenCount")
_OUTPUT = ("output_tokens", "completion_tokens", "candidates_token_count", "candidatesTokenCount")
_THOUGHTS = ("thoughts_token_count", "thoughtsTokenCount")
_TOTAL = ("total_tokens", "total_token_count", "totalTokenCount")
_REASONING = (
    "completion_tokens_details.reasoning_tokens",
    "output_tokens_details.reasoning_tokens",
)
_CACHED = (
    "cached_input_tokens",
    "cache_read_input_tokens",
    "cached_content_token_count",
    "cachedContentTokenCount",
    "input_tokens_details.cached_tokens",
    "prompt_tokens_details.cached_tokens",
)


def _first(usage: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_variant_get(usage, f"$.{p}", "bigint") for p in paths])


def usage_counts(usage: Column) -> Column:
    """The counts that a vendor usage object (variant) reports, as a struct."""
    places = {"input": _INPUT, "thoughts": _THOUGHTS, "reported": _OUTPUT, "total": _TOTAL, "reasoning": _REASONING, "cached": _CACHED}
    return F.struct(*[_first(usage, paths).alias(name) for name, paths in places.items()])


def reckoned(counts: Column) -> Column:
    """``usage_counts`` as a struct of four counts.

    Thinking tokens are billed as output. Reasoning tokens are added only when
    the vendor's own total shows that the output count leaves them out.
    """
    tokens_in, thoughts, reported = counts["input"], counts["thoughts"], counts["reported"]
    output = F.when(thoughts.isNotNull(), F.coalesce(reported, F.lit(0)) + thoughts).otherwise(reported)
    total, reasoning = counts["total"], counts["reasoning"]
    left_out = (reasoning > 0) & (total == tokens_in + output + reasoning)
    return F.struct(
        tokens_in.alias("input_tokens"),
        F.when(left_out, output + reasoning).otherwise(output).alias("output_tokens"),
        total.alias("total_tokens"),
        counts["cached"].alias("cached_input_tokens"),
    )


def normalize_usage(usage: Column) -> Column:
    """A vendor usage object (variant) as a struct of four counts."""
    return reckoned(usage_counts(usage))


def cost_usd(
    usage: Column,
    price_in: Column,
    price_out: Column,
    price_cached_in: Column,
    batch_discount: Column,
    run_mode: Column,
) -> Column:
    """The price of one call in dollars; null when prices or usage are unknown.

    Prices are per million tokens. The cached price applies only where it is
    declared and the cached count is part of the input count.
    """
    tokens_in, tokens_out = usage["input_tokens"], usage["output_tokens"]
    used_in = F.coalesce(tokens_in, F.lit(0))
    cached = F.coalesce(usage["cached_input_tokens"], F.lit(0))
    cheaper = price_cached_in.isNotNull() & (cached > 0) & (cached <= used_in)
    billed_in = F.when(
        cheaper, (used_in - cached) * price_in + cached * price_cached_in
    ).otherwise(used_in * price_in)
    factor = F.when(run_mode == "batch", F.coalesce(batch_discount, F.lit(1.0))).otherwise(1.0)
    billed = (billed_in + F.coalesce(tokens_out, F.lit(0)) * price_out) / 1_000_000 * factor
    known = price_in.isNotNull() & price_out.isNotNull() & (tokens_in.isNotNull() | tokens_out.isNotNull())
    return F.when(known, F.round(billed, 8))
