"""Review records for graded rows: seeding, judging, summing up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalgrid.functions import ids, parsing
from evalgrid.operators import gates, scope
from evalgrid.schemas import AUDIT_FLAGS, JUDGMENT
from evalgrid.session import cut

CHECK = ["model", "item", "dimension", "sub"]
#: Into how many ordered stretches the repeats of one check are split.
STRETCHES = 64


def _stretch(column: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` lie below the value, by halving; null comes first."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column <= F.lit(bounds[middle]), pick(low, middle)).otherwise(pick(middle + 1, high))

    return F.when(column.isNull(), F.lit(-1)).otherwise(pick(0, len(bounds)))


def with_occurrence(rows: DataFrame, keys: list[str], order: str, ties: list[str] | None = None) -> DataFrame:
    """Add ``occurrence``: the zero-based number of each row within its keys.

    A key may hold any share of the table, so it is never numbered in one
    piece. Quantiles cut the order column into stretches of about equal
    numbers of rows; each is numbered on its own and shifted by the rows in
    the stretches before it. Rows without an order come first. Only rows that
    are equal in order share a stretch whatever their number.
    """
    shares = [k / STRETCHES for k in range(1, STRETCHES)]
    found = rows.agg(F.percentile_approx(order, shares, F.lit(100 * STRETCHES))).first()[0] or []
    stretched = rows.withColumn("__stretch", _stretch(F.col(order), sorted(set(found))))
    sizes = stretched.groupBy(*keys, "__stretch").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    named = {k: f"__{k}" for k in (*keys, "__stretch")}
    shifts = sizes.select(
        *[F.col(k).alias(n) for k, n in named.items()], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift")
    )
    within = Window.partitionBy(*keys, "__stretch").orderBy(order, *(ties or []))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()]
    return (
        stretched.withColumn("__at", F.row_number().over(within) - 1)
        .join(shifts, same)
        .withColumn("occurrence", (F.col("__at") + F.col("__shift")).cast("bigint"))
        .drop("__at", "__shift", "__stretch", *named.values())
    )


def seed_records(
    scores: DataFrame,
    only_misses: bool = True,
    ties: list[str] | None = None,
    root: str = "outputs",
) -> DataFrame:
    """A blank review record for every graded row, or for every miss.

    The record carries the real generation as well as the occurrence number,
    so the answer it is about can be found without guessing. Rows read from
    score files have no generation: their place in the file is their order.
    """
    rows = cut(scope.misses(scores) if only_misses else scores)  # numbering reads them several times
    numbered = with_occurrence(rows, ["run_id", *CHECK], "generation", ties)
    run, model, item = F.col("run_id"), F.col("model"), F.col("item")
    place = [F.lit("#"), F.col("position").cast("string")] if "position" in scores.columns else []
    flags = [F.lit(flag == "key_valid").alias(flag) for flag in AUDIT_FLAGS]
    return numbered.select(
        ids.audit_id(run, model, item, F.col("dimension"), F.col("sub"), F.col("occurrence")).alias("audit_id"),
        "run_id",
        "occurrence",
        "generation",
        "item",
        "dimension",
        "sub",
        F.col("model").alias("graded_model"),
        F.col("correct").alias("deterministic_correct"),
        "weight",
        F.lit(None).cast("string").alias("judge_model"),
        F.lit("keep").alias("recommended_action"),
        F.lit("").alias("rationale"),
        F.concat(F.lit(f"{root}/"), run, F.lit("/scores/"), model, F.lit(".json"), *place).alias(
            "deterministic_score_pointer"
        ),
        F.concat(
            F.lit(f"{root}/"), run, F.lit("/raw/"), model, F.lit("__"), item, F.lit(".json#"),
            F.col("generation").cast("string"),
        ).alias("raw_output_pointer"),
        *flags,
    )


def answer_turn(dimension: Column, sub: Column) -> Column:
    """The turn whose answer a check was graded on."""
    return (
        F.when(dimension != "conviction", F.lit("response"))
        .when(sub == "initial", F.lit("setup"))
        .otherwise(sub)
    )


def request_payloads(records: DataFrame, responses: DataFrame) -> DataFrame:
    """What a judge gets to see: the record and the saved answer, no key text."""
    answers = responses.select(
        F.col("run_id"), F.col("model").alias("graded_model"), "item", "generation", "turn_id",
        F.col("text").alias("saved_model_output"),
    )
    return (
        records.withColumn("turn_id", answer_turn(F.col("dimension"), F.col("sub")))
        .join(answers, ["run_id", "graded_model", "item", "generation", "turn_id"], "left")
        .select(
            "audit_id", "item", "dimension", "sub", "graded_model", "deterministic_correct", "weight",
            "occurrence", "raw_output_pointer", "deterministic_score_pointer", "saved_model_output",
        )
    )


def _texts(blocks: Column, kinds: tuple[str, ...]) -> Column:
    wanted = F.filter(blocks, lambda b: b["type"].isin(*kinds) & b["text"].isNotNull())
    return F.nullif(F.array_join(F.transform(wanted, lambda b: b["text"]), ""), F.lit(""))


def judgment_text(line: Column) -> Column:
    """The judge's own text in a result line (variant) of either vendor."""
    block = "array<struct<type:string,text:string>>"
    outputs = F.try_variant_get(
        line, "$.response.body.output", f"array<struct<type:string,content:{block}>>"
    )
    messages = F.filter(outputs, lambda o: o["type"] == "message")
    parts = F.flatten(F.transform(messages, lambda o: F.coalesce(o["content"], F.array().cast(block))))
    return F.coalesce(
        F.nullif(F.try_variant_get(line, "$.response.body.output_text", "string"), F.lit("")),
        _texts(parts, ("output_text", "text")),
        _texts(F.try_variant_get(line, "$.result.message.content", block), ("text",)),
        _texts(F.try_variant_get(line, "$.message.content", block), ("text",)),
    )


def read_judgments(lines: DataFrame, text: str = "value") -> DataFrame:
    """Judge result lines as records; lines without one get an ``error``.

    A line is either the record itself or wraps its text the way a vendor does.
    The line's own id fills in when the record lacks one.
    """
    outer = parsing.hold(lines, "__line", F.try_parse_json(F.col(text)))
    flat = F.try_variant_get("__line", "$.audit_id", "string").isNotNull() & F.try_variant_get(
        "__line", "$.recommended_action", "string"
    ).isNotNull()
    spoken = parsing.hold(outer, "__text", F.when(~F.coalesce(flat, F.lit(False)), judgment_text(F.col("__line"))))
    inner = parsing.hold(
        spoken,
        "__record",
        F.when(flat, F.col("__line")).otherwise(F.try_parse_json(parsing.unfence(F.col("__text")))),
    )
    fields = [
        F.try_variant_get("__record", f"$.{name}", kind).alias(name) for name, kind in JUDGMENT.items()
    ]
    named = inner.select(
        *lines.columns,
        *fields,
        F.try_variant_get("__line", "$.custom_id", "string").alias("__custom_id"),
        F.when(F.col("__record").isNull(), "no parseable audit record").alias("error"),
    )
    return named.withColumn("audit_id", F.coalesce("audit_id", "__custom_id")).drop("__custom_id")


def merge_judgments(seeds: DataFrame, judgments: DataFrame, judge_model: str | None = None) -> DataFrame:
    """Judgments laid over their seeds; a judgment's own fields win."""
    verdict = ["judge_model", "recommended_action", "rationale", *AUDIT_FLAGS]
    mine = judgments.select("audit_id", *[F.col(f).alias(f"__{f}") for f in verdict])
    merged = mine.join(seeds, "audit_id", "left")
    for field in verdict:
        merged = merged.withColumn(field, F.coalesce(F.col(f"__{field}"), F.col(field))).drop(f"__{field}")
    if judge_model:
        merged = merged.withColumn(
            "judge_model", F.coalesce(F.nullif("judge_model", F.lit("")), F.lit(judge_model))
        )
    return merged


def judged(lines: DataFrame, seeds: DataFrame, judge_model: str | None = None) -> DataFrame:
    """Every line of a judge file as a record with its ``errors``, bad ones included.

    Unreadable lines have their text in ``value`` and one error.
    """
    read = read_judgments(lines).withColumn("__readable", F.col("error").isNull())
    good = gates.judgment_errors(merge_judgments(seeds, read.filter("__readable"), judge_model))
    bad = read.filter("not __readable").select("value", F.array("error").alias("errors"))
    return good.unionByName(bad, allowMissingColumns=True)


def file_errors(lines: DataFrame, seeds: DataFrame, judge_model: str | None = None) -> DataFrame:
    """(audit_id, value, errors) of every unreadable and every invalid line."""
    return judged(lines, seeds, judge_model).filter(F.size("errors") > 0).select("audit_id", "value", "errors")


def ingest_judgments(lines: DataFrame, seeds: DataFrame, judge_model: str | None = None) -> DataFrame:
    """Records of a judge file, all or nothing.

    Every unreadable or invalid line is written to one list and nothing is kept.
    """
    records = judged(lines, seeds, judge_model)
    gates.must_be_empty(
        records.filter(F.size("errors") > 0).select("audit_id", "value", "errors"), "unreadable or invalid judge lines"
    )
    return records.drop("errors", "value")


def with_issues(records: DataFrame) -> DataFrame:
    """Add what a record calls into question."""
    key_issue = (
        F.coalesce("missing_acceptable_answer", F.lit(False))
        | F.coalesce("overstrict", F.lit(False))
        | F.coalesce("understrict", F.lit(False))
        | F.coalesce("source_mismatch", F.lit(False))
        | ~F.coalesce("key_valid", F.lit(True))
    )
    acts = F.coalesce(F.col("recommended_action").isin("review_key", "edit_key", "pull_item", "needs_human"), F.lit(False))
    return (
        records.withColumn("key_issue", key_issue)
        .withColumn("disputed_miss", ~F.coalesce("deterministic_correct", F.lit(True)) & F.col("key_issue"))
        .withColumn("fairness_flag", F.coalesce("fairness_risk", F.lit(False)))
        .withColumn("key_review", F.col("key_issue") | acts)
    )


def summarize(records: DataFrame) -> DataFrame:
    """Counts over everything and by action, item and graded model in one pass."""
    by = ["recommended_action", "item", "graded_model"]
    marked = with_issues(records)
    counted = [F.count_if(F.coalesce(flag, F.lit(False))).alias(flag) for flag in AUDIT_FLAGS]
    counted += [F.count_if(m).alias(m) for m in ("disputed_miss", "fairness_flag", "key_review")]
    summed = marked.groupingSets([[c] for c in by] + [[]], *by).agg(
        F.grouping_id().alias("__grouping"), F.count(F.lit(1)).alias("records"), *counted
    )
    facet = (
        F.when(F.col("__grouping") == 3, "action")
        .when(F.col("__grouping") == 5, "item")
        .when(F.col("__grouping") == 6, "model")
        .otherwise("all")
    )
    value = (
        F.when(facet == "action", F.coalesce("recommended_action", F.lit("None")))
        .when(facet == "item", F.coalesce("item", F.lit("None")))
        .when(facet == "model", F.coalesce("graded_model", F.lit("None")))
        .otherwise("")
    )
    return summed.select(facet.alias("facet"), value.alias("value"), "records", *AUDIT_FLAGS,
                         "disputed_miss", "fairness_flag", "key_review")
