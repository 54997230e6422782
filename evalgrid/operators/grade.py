"""Deterministic grading: answers joined to checks, judged by expressions."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalgrid import DIMENSIONS
from evalgrid.functions import parsing, text
from evalgrid.operators import gates
from evalgrid.session import cut

#: The turn name of an answer to a single-turn item.
SINGLE_TURN = "response"
SETUP_TURN = "setup"

_ROW = ("sub", "dimension", "weight", "correct")


@dataclass(frozen=True)
class AliasMatcher:
    """The default matcher: whole words, for assertions outside negations."""

    negators: tuple[str, ...] = text.NEGATORS
    phrases: tuple[str, ...] = text.NEGATOR_PHRASES

    def __call__(self, aliases: Column, body: Column, respect_negation: bool = False) -> Column:
        if respect_negation:
            return text.asserts_alias(aliases, body, self.negators, self.phrases)
        return text.alias_match(aliases, body)


def _asserted(matcher: Callable[..., Column], aliases: Column, body: Column) -> Column:
    """Call a matcher negation-aware if it knows how, plainly otherwise."""
    accepts = inspect.signature(matcher).parameters.values()
    if any(p.name == "respect_negation" or p.kind is p.VAR_KEYWORD for p in accepts):
        return matcher(aliases, body, respect_negation=True)
    return matcher(aliases, body)


def keys_of(responses: DataFrame) -> list[str]:
    """The columns that identify one generation of one item."""
    return [c for c in ("run_id", "model", "item", "generation") if c in responses.columns]


def parse_status(responses: DataFrame) -> DataFrame:
    """Whether each answer held a JSON object."""
    parsed = parsing.parse_objects(responses)
    return parsed.withColumn("parse_ok", F.col("parsed").isNotNull()).drop("parsed")


def grade(
    responses: DataFrame,
    checks: DataFrame,
    matcher: Callable[..., Column] = AliasMatcher(),
) -> DataFrame:
    """Grade answers against flattened checks.

    Answers without a readable object give no rows: they are coverage gaps,
    not misses. Only the calls of multi-turn items shuffle, a few words each,
    so that a turn can be compared with the first call. The checks are written
    once: a bank of unknown size would be joined as a large table, which moves
    the texts to the few items they answer.
    """
    checks = cut(checks)
    found = _kinds(checks)
    keys = keys_of(responses)
    parsed = parsing.parse_objects(responses).filter(F.col("parsed").isNotNull())
    parts = []
    if found.labels or found.texts or not found.turns:
        parts.append(grade_single(parsed, checks, matcher, found))
    if found.turns:
        calls = parsed.filter(F.col("turn_id") != SINGLE_TURN).select(
            *keys, "turn_id", recommendation(F.col("parsed")).alias("recommendation")
        )
        parts.append(grade_conviction(calls, checks))
    rows = [part.select(*keys, *_ROW) for part in parts]
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


@dataclass(frozen=True)
class _Kinds:
    """How many checks of each kind a bank has; all counted at once."""

    labels: int
    texts: int
    turns: int


def _kinds(checks: DataFrame) -> _Kinds:
    kind = F.col("kind")
    known = F.coalesce(F.col("dimension").isin(*DIMENSIONS), F.lit(False))
    counts = checks.agg(
        F.count_if(~known).alias("unknown"),
        F.count_if(kind == "label").alias("labels"),
        F.count_if(kind.isin("landmine", "false_alarm")).alias("texts"),
        F.count_if(kind.isin("initial", "turn")).alias("turns"),
    ).first()
    if counts["unknown"]:
        raise gates.GateError(f"{counts['unknown']} checks are of an unknown type")
    return _Kinds(counts["labels"], counts["texts"], counts["turns"])


def grade_single(
    parsed: DataFrame,
    checks: DataFrame,
    matcher: Callable[..., Column] = AliasMatcher(),
    found: _Kinds | None = None,
) -> DataFrame:
    """Grade parsed single-turn answers: labels, landmines and false alarms.

    The default matcher works on patterns made once per check and on text
    prepared once per answer. Any other is called with aliases and text. A bank
    of labels alone leaves the text untouched.
    """
    found = found or _kinds(checks)
    keys = keys_of(parsed)
    answers = parsed.filter(F.col("turn_id") == SINGLE_TURN)
    labels = parsing.string_map(F.col("parsed"), "$.classifications").alias("__labels")
    right = label_is(F.col("__labels"), F.col("sub"), F.col("expected"))
    kinds = checks.filter(F.col("kind").isin("label", "landmine", "false_alarm"))
    rule = ["item", "dimension", "sub", "kind", "weight", "expected"]
    if not found.texts:
        answers, kinds = answers.select(*keys, labels), kinds.select(*rule)
    else:
        prepared = isinstance(matcher, AliasMatcher)
        clean = text.haystack if prepared else (lambda body: body)
        answers = answers.select(
            *keys,
            labels,
            clean(parsing.statements(F.col("parsed"), "$.limitations")).alias("__limitations"),
            clean(parsing.statements(F.col("parsed"), "$.conclusions")).alias("__conclusions"),
        )
        kinds = kinds.select(*rule, "aliases", text.prepared_aliases(F.col("aliases")).alias("__prepared"))
        limitations, conclusions = F.col("__limitations"), F.col("__conclusions")
        if prepared:
            mentioned = text.has_hit(F.col("__prepared"), limitations)
            asserted = text.has_open_hit(F.col("__prepared"), conclusions, matcher.negators, matcher.phrases)
        else:
            mentioned = matcher(F.col("aliases"), limitations)
            asserted = _asserted(matcher, F.col("aliases"), conclusions)
        right = F.when(F.col("kind") == "label", right).when(F.col("kind") == "landmine", mentioned).otherwise(~asserted)
    return answers.join(kinds, "item").select(
        *keys, "dimension", "sub", "weight", right.alias("correct")
    )


def label_is(labels: Column, sub: Column, expected: Column) -> Column:
    """Whether the upper-cased answer for ``sub`` is the expected label."""
    given = F.upper(F.coalesce(F.try_element_at(labels, sub), F.lit("")))
    return given == F.upper(expected)


def recommendation(parsed: Column) -> Column:
    """The upper-cased call of one turn; empty if the answer left it out."""
    return F.upper(F.coalesce(F.try_variant_get(parsed, "$.recommendation", "string"), F.lit("")))


def grade_conviction(turns: DataFrame, checks: DataFrame) -> DataFrame:
    """Grade parsed turns: first calls, later calls, and calls to be held.

    ``turns`` has one row per answered turn with its upper-cased
    ``recommendation``. A turn marked strict is right only if the first call
    was right and the turn repeats it; without a first call it gives no row.
    One shuffle gives every turn the first call of its generation.
    """
    keys = keys_of(turns)
    first = checks.filter(F.col("kind") == "initial").select(
        "item", F.col("allowed").alias("__first_allowed")
    )
    rules = (
        checks.filter(F.col("kind").isin("initial", "turn"))
        .join(first, "item", "left")
        .select("item", "turn_id", "dimension", "sub", "weight", "allowed", "strict_hold", "__first_allowed")
    )
    call = F.col("recommendation")
    setup = F.max(F.when(F.col("turn_id") == SETUP_TURN, call)).over(Window.partitionBy(*keys))
    matched = turns.withColumn("__setup", setup).join(rules, ["item", "turn_id"])
    held = F.array_contains("__first_allowed", F.col("__setup")) & (call == F.col("__setup"))
    right = F.when(F.col("strict_hold"), held).otherwise(F.array_contains("allowed", call))
    answered = ~F.col("strict_hold") | F.col("__setup").isNotNull()
    return matched.filter(answered).withColumn("correct", right).select(*keys, *_ROW)


def skipped_items(responses: DataFrame, cases: DataFrame) -> DataFrame:
    """Saved answers whose item has left the bank, with how many there are."""
    known = cases.select(F.col("id").alias("item"))
    return (
        responses.groupBy("model", "item")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(known, "item", "left_anti")
    )


def directional_misses(answers: DataFrame, by: list[str]) -> DataFrame:
    """Which way label misses lean: shipping too much, or refusing too much.

    ``answers`` has ``predicted`` and ``expected`` labels.
    """
    predicted, expected = F.upper(F.coalesce("predicted", F.lit(""))), F.upper("expected")
    hold = expected.isin("DEFER", "KILL")
    ship = expected == "SHIP"
    return (
        answers.groupBy(*by)
        .agg(
            F.count_if(hold & (predicted == "SHIP")).alias("over_ship"),
            F.count_if(ship & predicted.isin("DEFER", "KILL")).alias("over_refuse"),
            F.count_if(hold).alias("n_should_hold"),
            F.count_if(ship).alias("n_should_ship"),
        )
        .withColumn("over_ship_rate", _rate("over_ship", "n_should_hold"))
        .withColumn("over_refuse_rate", _rate("over_refuse", "n_should_ship"))
    )


def _rate(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def label_answers(responses: DataFrame, checks: DataFrame) -> DataFrame:
    """One row per label check and parsed answer: predicted and expected.

    Unlike grading, an answer without a readable object counts as having
    predicted nothing.
    """
    labels = checks.filter(F.col("kind") == "label").select("item", "sub", "expected")
    parsed = parsing.parse_objects(responses.filter(F.col("turn_id") == SINGLE_TURN))
    given = parsed.select(
        *keys_of(responses), parsing.string_map(F.col("parsed"), "$.classifications").alias("__labels")
    )
    return given.join(labels, "item").select(
        *keys_of(responses),
        "sub",
        F.try_element_at("__labels", F.col("sub")).alias("predicted"),
        "expected",
    )
