"""Coverage of a bank by graded rows, and completeness of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid import DIMENSIONS
from evalgrid.operators import gates, scan, scope
from evalgrid.session import cut

# Fixed value: the share of items and checks a ranked model must have.
RANKED_COVERAGE = 1.0
#: Checks in a word of a coverage bitmap.
WORD = 63


def coverage_board(sums: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """How much of the intended bank each model was graded on.

    ``sums`` are check sums; ``expected`` lists the bank's checks. The bank,
    not what happened to parse, is the denominator.
    """
    bank = expected.agg(
        F.countDistinct("item").alias("items"), F.count(F.lit(1)).alias("checks")
    )
    every = F.array(*[F.lit(d) for d in DIMENSIONS])
    joined = (
        sums.groupBy(*keys)
        .agg(
            F.countDistinct("item").alias("n_items"),
            F.count(F.lit(1)).alias("n_checks"),
            F.sum("n").alias("n_atomic"),
            F.array_except(every, F.collect_set("dimension")).alias("missing_dimensions"),
        )
        .withColumn("bank_items", bank.select("items").scalar())
        .withColumn("bank_checks", bank.select("checks").scalar())
    )
    items = F.try_divide(F.col("n_items"), F.col("bank_items"))
    checks = F.try_divide(F.col("n_checks"), F.col("bank_checks"))
    baseline = scope.is_baseline(F.col("model"))
    eligible = (
        ~baseline
        & (F.coalesce(items, F.lit(0.0)) >= RANKED_COVERAGE)
        & (F.coalesce(checks, F.lit(1.0)) >= RANKED_COVERAGE)
        & (F.size("missing_dimensions") == 0)
    )
    return joined.select(
        *keys,
        "n_items",
        "n_checks",
        "n_atomic",
        F.round(F.coalesce(items, F.lit(0.0)), 4).alias("coverage_ratio"),
        F.round(checks, 4).alias("check_coverage_ratio"),
        F.array_join("missing_dimensions", ",").alias("missing_dimensions"),
        baseline.alias("is_baseline"),
        eligible.alias("ranked_eligible"),
        F.when(baseline, "baseline").when(eligible, "ranked").otherwise("provisional").alias("coverage_status"),
    )


def coverage_gaps(sums: DataFrame, expected: DataFrame, roster: DataFrame, on: list[str]) -> DataFrame:
    """Checks not graded exactly as often as intended.

    ``roster`` names the models with their ``generations``, per run where
    ``on`` holds the run's column; ``expected`` lists the checks of the bank
    that all of them owe. The grid of models and checks is never built: checks
    are numbered, what a model was graded on is a bitmap of ``WORD`` checks a
    word, and only the bits that a word lacks become rows.
    """
    check, owner = ["item", "dimension", "sub"], [*on, "model"]
    place = [F.col(c).asc_nulls_first() for c in check]
    bank = scan.numbered(expected.select(*check).distinct(), place, "__n")
    bank = cut(bank.select(*check, F.floor((F.col("__n") - 1) / WORD).alias("__word"), ((F.col("__n") - 1) % WORD).cast("int").alias("__bit")))
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__bit")))
    seen = sums.groupBy(*owner, *check).agg(F.sum("n").alias("n_seen")).filter("n_seen > 0")
    seen = cut(seen.join(bank, check, "left").join(roster.select(*owner, "generations"), owner))
    off = seen.select(
        *owner, *check, "n_seen", F.when(F.col("__word").isNull(), 0).otherwise(F.col("generations")).alias("n_intended")
    )
    words = bank.groupBy("__word").agg(mask.alias("__all"))
    n_words = bank.agg(F.coalesce(F.max("__word") + 1, F.lit(0))).scalar()
    owed = roster.filter("generations > 0").select(*owner, "generations", n_words.alias("__words")).filter("__words > 0")
    owed = owed.select(*owner, "generations", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__words") - 1)).alias("__word"))
    had = seen.filter("__word is not null").groupBy(*owner, "__word").agg(mask.alias("__had"))
    lacks = F.col("__all").bitwiseAND(F.bitwise_not(F.coalesce("__had", F.lit(0).cast("bigint"))))
    short = owed.join(words, "__word").join(had, [*owner, "__word"], "left").withColumn("__lacks", lacks).filter("__lacks <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit("__lacks", b) == 1)
    missing = (
        short.select(*owner, "generations", "__word", F.explode(bits).alias("__bit"))
        .join(bank, ["__word", "__bit"])
        .select(*owner, *check, F.lit(0).cast("bigint").alias("n_seen"), F.col("generations").alias("n_intended"))
    )
    found, wanted = F.col("n_seen"), F.coalesce("n_intended", F.lit(0))
    status = (
        F.when(wanted == 0, "unexpected")
        .when(found == 0, "missing")
        .when(found < wanted, "short")
        .when(found > wanted, "extra")
    )
    return off.unionByName(missing).select(
        *owner, *check, found.alias("n_seen"), wanted.alias("n_intended"), status.alias("status")
    ).filter(F.col("status").isNotNull())


def coverage_counts(sums: DataFrame, expected: DataFrame, roster: DataFrame) -> DataFrame:
    """Per model, how many checks were graded exactly, too rarely or too often.

    ``sums`` are check sums of one run, ``roster`` has ``model`` and
    ``generations``. Missing checks follow from the counts, so no grid of
    models and checks is built.
    """
    check = ["item", "dimension", "sub"]
    planned = expected.select(*check, F.lit(True).alias("__planned"))
    n_expected = expected.agg(F.count(F.lit(1)).alias("n")).scalar()
    hits = F.coalesce("__planned", F.lit(False))
    counts = (
        sums.join(planned, check, "left")
        .join(roster, "model")
        .groupBy("model")
        .agg(
            F.sum("n").alias("n_atomic"),
            F.count_if(hits & (F.col("n") == F.col("generations"))).alias("n_exact"),
            F.count_if(hits & (F.col("n") < F.col("generations"))).alias("n_short"),
            F.count_if(hits & (F.col("n") > F.col("generations"))).alias("n_extra"),
            F.count_if(~hits).alias("n_unexpected"),
        )
    )
    seen = F.col("n_exact") + F.col("n_short") + F.col("n_extra")
    return counts.withColumn("n_missing", n_expected - seen).withColumn(
        "complete", (F.col("n_exact") == n_expected) & (F.col("n_unexpected") == 0)
    )


def complete_generations(graded: DataFrame, expected: DataFrame) -> DataFrame:
    """The generations that grade every check of their item exactly once.

    Items that have left the bank count for nothing.
    """
    one = ["model", "item", "generation"]
    check = ["item", "dimension", "sub"]
    planned = expected.select(*check).distinct().withColumn("__planned", F.lit(True))
    per_item = planned.groupBy("item").agg(F.count(F.lit(1)).alias("n_expected"))
    return (
        graded.groupBy(*one, "dimension", "sub")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(planned, check, "left")
        .groupBy(*one)
        .agg(
            F.count_if((F.col("n") == 1) & F.col("__planned")).alias("n_once"),
            F.sum("n").alias("n_rows"),
        )
        .join(per_item, "item")
        .filter("n_once = n_expected and n_rows = n_expected")
        .select(*one)
    )


def generation_counts(
    responses: DataFrame, graded: DataFrame, expected: DataFrame, roster: DataFrame
) -> DataFrame:
    """Per model of ``roster``, how many saved generations are incomplete or surplus."""
    one = ["model", "item", "generation"]
    items = expected.select("item").distinct()
    n_items = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    complete = (
        complete_generations(graded, expected)
        .join(roster, "model")
        .filter("generation < generations")
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("n_complete"))
    )
    surplus = (
        responses.select(*one)
        .distinct()
        .join(items, "item", "left_semi")
        .join(roster, "model")
        .filter("generation >= generations")
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("n_extra"))
    )
    return (
        roster.join(complete, "model", "left")
        .join(surplus, "model", "left")
        .select(
            "model",
            (F.col("generations") * n_items).alias("n_intended"),
            (F.col("generations") * n_items - F.coalesce("n_complete", F.lit(0))).alias("n_incomplete"),
            F.coalesce("n_extra", F.lit(0)).alias("n_extra"),
        )
    )


def regrade_mismatches(saved: DataFrame, regraded: DataFrame) -> DataFrame:
    """Score rows that differ in number between a saved and a fresh grading."""
    return gates.multiset_difference(
        saved, regraded, ["model", "item", "dimension", "sub", "correct", "weight"]
    )


def completeness_errors(
    requested: DataFrame | list[str],
    models: DataFrame,
    responses: DataFrame,
    saved: DataFrame,
    graded: DataFrame,
    expected: DataFrame,
    generations: int,
    case_scope: str = scope.ALL,
    dimensions: tuple[str, ...] = DIMENSIONS,
    recorded: DataFrame | None = None,
    current: DataFrame | None = None,
) -> DataFrame:
    """All reasons why a run may not be published, one row each.

    ``requested`` lists the models, or is a table with a column ``model``.
    ``n`` counts what its reason is about: rows, generations, or kinds of differing rows.
    Only unknown names are reported while a requested model is unknown. Scores
    and answers outside ``case_scope`` do not count. Mock models are graded
    once, all others ``generations`` times, and each model needs all
    ``dimensions``. ``recorded`` is the run's bank manifest and ``current`` the
    bank's signature, whose fingerprints must agree; leave both out to skip
    that.

    Requests, registry, scores, answers and differences are reduced to facts
    of a model, each for itself, and meet in one grouping by model; the rules
    are expressions over its row. Nothing is decided on the driver.
    """
    if isinstance(requested, list):
        requested = saved.sparkSession.createDataFrame([(name,) for name in requested], "model string")
    saved, responses, graded, expected = (scope.in_scope(df, case_scope) for df in (saved, responses, graded, expected))
    graded = cut(graded)
    bank = expected.agg(F.struct(F.count(F.lit(1)).alias("checks"), F.countDistinct("item").alias("items"))).scalar()
    facts = [
        requested.select("model", F.lit(1).alias("wanted")),
        models.select(
            F.col("name").alias("model"), F.lit(1).alias("known"), F.when(F.col("provider") == "mock", 1).otherwise(generations).alias("owed")
        ),
        _score_facts(saved, expected, generations, dimensions),
        _answer_facts(responses, graded, expected, generations),
        regrade_mismatches(saved.join(expected.select("item").distinct(), "item", "left_semi"), graded)
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("differing")),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    merged = every.groupBy("model").agg(*[F.max(c).alias(c) for c in every.columns if c != "model"])
    row = cut(merged.withColumn("bank", bank))
    n_unknown = row.filter("wanted = 1 and known is null").agg(F.count(F.lit(1))).scalar()

    def number(column: str) -> Column:
        """The fact as counted for what the model owes: one generation or all."""
        own = F.when(F.col("owed") == 1, F.col(f"{column}_once")).otherwise(F.col(f"{column}_full"))
        return F.coalesce(own, F.lit(0))

    known, scored = F.col("known").isNotNull(), F.col("n_atomic").isNotNull()
    rated = known & scored
    gap = (number("exact") != F.col("bank.checks")) | (F.col("unexpected") > 0) | (F.col("spans") < len(dimensions))
    lacking, surplus = F.col("owed") * F.col("bank.items") - number("complete"), number("surplus")
    differing = F.coalesce("differing", F.lit(0))
    one = F.lit(1)
    reasons = [
        (F.col("wanted").isNotNull() & ~known, "unknown requested model", one),
        (F.col("wanted").isNotNull() & known & ~scored, "score file missing", one),
        (scored & ~known, "scores of an unknown model", one),
        (rated & gap, "score coverage incomplete", F.col("n_atomic")),
        (rated & (lacking > 0), "raw generations incomplete", lacking),
        (rated & (surplus > 0), "raw generations unexpected", surplus),
        (rated & (lacking <= 0) & (surplus == 0) & (differing > 0), "saved scores do not match regrade", differing),
    ]
    found = F.array_compact(F.array(*[
        F.when(holds, F.struct(F.lit(words).alias("error"), n.cast("bigint").alias("n"))) for holds, words, n in reasons
    ]))
    errors = row.withColumn("n_unknown", n_unknown).select("model", "n_unknown", F.explode(found).alias("e"))
    errors = errors.filter((F.col("n_unknown") == 0) | (F.col("e.error") == reasons[0][1])).select("model", "e.error", "e.n")
    if recorded is not None and current is not None:
        errors = errors.unionByName(_fingerprint_error(recorded, current, case_scope, n_unknown))
    return errors


def _score_facts(saved: DataFrame, expected: DataFrame, generations: int, dimensions: tuple[str, ...]) -> DataFrame:
    """Per model: rows, checks graded once and in full, unplanned checks, dimensions."""
    check = ["item", "dimension", "sub"]
    planned = expected.select(*check).distinct().withColumn("__planned", F.lit(True))
    sums = saved.groupBy("model", *check).agg(F.count(F.lit(1)).alias("n")).join(planned, check, "left")
    hits = F.coalesce("__planned", F.lit(False))
    return sums.groupBy("model").agg(
        F.sum("n").alias("n_atomic"),
        F.count_if(hits & (F.col("n") == 1)).alias("exact_once"),
        F.count_if(hits & (F.col("n") == generations)).alias("exact_full"),
        F.count_if(~hits).alias("unexpected"),
        F.size(F.array_intersect(F.collect_set("dimension"), F.array(*map(F.lit, dimensions)))).alias("spans"),
    )


def _answer_facts(responses: DataFrame, graded: DataFrame, expected: DataFrame, generations: int) -> DataFrame:
    """Per model: complete and surplus generations, of one owed and of all."""
    one = ["model", "item", "generation"]
    complete = complete_generations(graded, expected).select(*one, F.lit(True).alias("__complete"))
    said = responses.join(expected.select("item").distinct(), "item", "left_semi").select(*one, F.lit(False).alias("__complete"))
    # one row per generation, whether it was answered, graded in full, or both
    each = said.unionByName(complete).groupBy(*one).agg(
        F.bool_or("__complete").alias("__complete"), F.bool_or(~F.col("__complete")).alias("__said")
    )
    at = F.col("generation")
    return each.groupBy("model").agg(
        F.count_if(F.col("__complete") & (at < 1)).alias("complete_once"),
        F.count_if(F.col("__complete") & (at < generations)).alias("complete_full"),
        F.count_if(F.col("__said") & (at >= 1)).alias("surplus_once"),
        F.count_if(F.col("__said") & (at >= generations)).alias("surplus_full"),
    )


def _fingerprint_error(recorded: DataFrame, current: DataFrame, case_scope: str, n_unknown: Column) -> DataFrame:
    """One row unless a manifest of the scope has the current fingerprint."""
    now = current.select("scope", "evaluation_hash", F.lit(True).alias("__same")).distinct()
    both = recorded.filter(F.col("scope") == case_scope).join(now, ["scope", "evaluation_hash"], "left")
    counted = both.agg(F.count(F.lit(1)).alias("n_old"), F.count("__same").alias("n_same")).withColumn("n_unknown", n_unknown)
    words = F.when(F.col("n_old") > 0, "saved evaluation fingerprint does not match").otherwise("saved bank manifest missing")
    return counted.filter("n_same = 0 and n_unknown = 0").select(
        F.lit("").alias("model"), words.alias("error"), F.lit(1).cast("bigint").alias("n")
    )
