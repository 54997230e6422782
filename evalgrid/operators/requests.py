"""Requests for the next stage, and what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions import ids, usage
from evalgrid.functions.parsing import hold
from evalgrid.operators import gates
from evalgrid.session import cut, slices

# Fixed value: the layout of a single-turn prompt.
_FEATURES_TITLE = "Candidate features:\n"


def user_prompt(brief: Column, features: Column, prompt: Column) -> Column:
    """Brief, feature list and question, blank parts left out."""
    listed = F.array_join(
        F.transform(features, lambda f: F.concat(F.lit("- "), f["id"], F.lit(": "), f["label"])), "\n"
    )
    parts = [
        F.nullif(brief, F.lit("")),
        F.when(F.size(features) > 0, F.concat(F.lit(_FEATURES_TITLE), listed)),
        F.nullif(prompt, F.lit("")),
    ]
    return F.btrim(F.concat_ws("\n\n", *parts), F.lit(" \n\r\t"))


def turn_plan(cases: DataFrame) -> DataFrame:
    """The turns each item is asked in, in order, with what is asked."""
    single = cases.filter("type <> 'conviction'").select(
        F.col("id").alias("item"),
        F.lit("response").alias("turn_id"),
        F.lit(0).alias("position"),
        user_prompt(F.col("brief"), F.col("features"), F.col("prompt")).alias("content"),
    )
    multi = cases.filter("type = 'conviction'")
    setup = multi.select(
        F.col("id").alias("item"), F.lit("setup").alias("turn_id"), F.lit(0).alias("position"),
        F.col("setup_prompt").alias("content"),
    )
    later = multi.select(F.col("id").alias("item"), F.posexplode("turns").alias("p", "t")).select(
        "item", F.col("t.id").alias("turn_id"), (F.col("p") + 1).alias("position"), F.col("t.content").alias("content")
    )
    return single.unionByName(setup).unionByName(later)


def pending_turns(planned: DataFrame, answers: DataFrame, thread: list[str]) -> DataFrame:
    """The first turn without an answer, for every thread that has one.

    ``planned`` has one row per ``thread`` and turn with its ``position``. The
    first gap is a plain minimum, so long threads are reduced before they are
    shuffled.
    """
    done = answers.filter(F.length("text") > 0).select(*thread, "turn_id").distinct()
    return (
        planned.join(done, [*thread, "turn_id"], "left_anti")
        .groupBy(*thread)
        .agg(F.min_by("turn_id", "position").alias("turn_id"), F.min("position").alias("position"))
    )


def conversation_rows(
    asked: DataFrame, answers: DataFrame, pending: DataFrame, thread: list[str], system: str | None = None
) -> DataFrame:
    """The messages that go with each pending turn, one row per message.

    ``asked`` has the question of every turn, ``answers`` what was said to it.
    Rows are numbered by ``position`` and role, so a request is put together by
    sorting; nothing is gathered here.
    """
    limit = pending.select(*thread, F.col("position").alias("__limit"))
    questions = asked.join(limit, thread).filter("position <= __limit").select(
        *thread, (F.col("position") * 2).alias("message"), F.lit("user").alias("role"), "content"
    )
    replies = (
        answers.join(asked.select(*thread, "turn_id", "position"), [*thread, "turn_id"])
        .join(limit, thread)
        .filter("position < __limit")
        .select(
            *thread, (F.col("position") * 2 + 1).alias("message"), F.lit("assistant").alias("role"),
            F.col("text").alias("content"),
        )
    )
    rows = questions.unionByName(replies)
    if system is not None:
        rows = rows.unionByName(
            pending.select(*thread, F.lit(-1).alias("message"), F.lit("system").alias("role"),
                           F.lit(system).alias("content"))
        )
    return rows


def request_bodies(rows: DataFrame, pending: DataFrame, thread: list[str]) -> DataFrame:
    """One request per pending turn, its messages in order.

    A request is one message list; its length is the number of turns of a case.
    """
    listed = rows.groupBy(*thread).agg(
        F.sort_array(F.collect_list(F.struct("message", "role", "content"))).alias("m")
    )
    messages = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return pending.join(listed.select(*thread, messages.alias("messages")), thread)


def owed_turns(plan: DataFrame, models: DataFrame, generations: int) -> DataFrame:
    """Every turn of ``plan`` that every model owes, in every generation.

    Turns are dealt over slots and the models stand in each slot, so this is a
    join on the slot whose work spreads over all tasks, however many there are.
    """
    slots = slices(plan.sparkSession)
    everywhere = models.select("model", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("__slot"))
    dealt = plan.withColumn("__slot", F.pmod(F.hash("item", "turn_id"), F.lit(slots)))
    owed = F.sequence(F.lit(0).cast("bigint"), F.lit(generations - 1).cast("bigint"))
    return dealt.join(everywhere, "__slot").drop("__slot").withColumn("generation", F.explode(owed))


def stage_requests(
    models: DataFrame, cases: DataFrame, answers: DataFrame, generations: int,
    run_id: str, previous: DataFrame | None = None, max_tokens: int = 2048, system: str | None = None,
) -> DataFrame:
    """The manifest of the next stage for all batch models.

    Every model owes every item ``generations`` answers; what has arrived
    decides which turn is asked next. Ids that collide are an error.
    """
    roster = models.filter((F.col("provider") != "mock") & F.col("batch_supported"))
    roster = roster.select(F.col("name").alias("model"), "provider", F.col("id").alias("model_id"),
                           "price_in", "price_out", "price_cached_in", "batch_discount", F.lit(run_id).alias("run_id"))
    thread = ["model", "item", "generation"]
    planned = owed_turns(turn_plan(cases), roster, generations)
    waiting = pending_turns(planned, answers, thread)
    bodies = request_bodies(conversation_rows(planned, answers, waiting, thread, system), waiting, thread)
    kinds = cases.select(F.col("id").alias("item"), F.col("type").alias("schema"))
    stage = F.lit(1)
    if previous is not None:
        last = previous.groupBy("model").agg(F.max("stage").alias("__last"))
        bodies = bodies.join(last, "model", "left")
        stage = F.coalesce(F.col("__last"), F.lit(0)) + 1
    out = (
        bodies.join(kinds, "item")
        .join(roster, "model")
        .select(
            ids.custom_id(F.col("model"), F.col("item"), F.col("generation"), F.col("turn_id")).alias("custom_id"),
            "run_id", stage.alias("stage"), "item", "generation", "turn_id", "schema", "provider", "model",
            "model_id", "price_in", "price_out", "price_cached_in", "batch_discount", "messages",
            F.lit(max_tokens).alias("max_tokens"),
        )
    )
    made = cut(out)
    gates.must_be_empty(gates.duplicate_ids(made, "custom_id"), "request id collision")
    return made


def _join_text(parts: Column) -> Column:
    return F.coalesce(F.array_join(parts, ""), F.lit(""))


def answer_text(line: Column, provider: Column) -> Column:
    """The answer in a vendor's result line (variant)."""
    block = "array<struct<type:string,text:string>>"
    outputs = F.try_variant_get(line, "$.response.body.output", f"array<struct<type:string,content:{block}>>")
    parts = F.flatten(
        F.transform(
            F.filter(outputs, lambda o: o["type"] == "message"),
            lambda o: F.coalesce(o["content"], F.array().cast(block)),
        )
    )
    spoken = F.filter(parts, lambda p: p["type"].isin("output_text", "text") & p["text"].isNotNull())
    openai = F.coalesce(
        F.nullif(F.try_variant_get(line, "$.response.body.output_text", "string"), F.lit("")),
        _join_text(F.transform(spoken, lambda p: p["text"])),
    )
    blocks = F.try_variant_get(line, "$.result.message.content", block)
    anthropic = _join_text(
        F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    )
    shape = "array<struct<content:struct<parts:array<struct<text:string>>>>>"
    candidates = F.coalesce(
        F.try_variant_get(line, "$.response.candidates", shape), F.try_variant_get(line, "$.candidates", shape)
    )
    pieces = F.flatten(
        F.transform(
            candidates,
            lambda c: F.coalesce(c["content"]["parts"], F.array().cast("array<struct<text:string>>")),
        )
    )
    google = _join_text(F.transform(F.filter(pieces, lambda p: p["text"].isNotNull()), lambda p: p["text"]))
    return F.when(provider == "openai", openai).when(provider == "anthropic", anthropic).when(
        provider == "google", google
    )


def _google_path(line: Column, *names: str, dtype: str = "string") -> Column:
    places = [f"$.response.{n}" for n in names] + [f"$.{n}" for n in names]
    return F.coalesce(*[F.try_variant_get(line, p, dtype) for p in places])


def finish_reason(line: Column, provider: Column) -> Column:
    """Why the answer ended; several distinct reasons are comma-joined."""
    shape = "array<struct<finishReason:string,finish_reason:string>>"
    per_candidate = F.coalesce(
        F.transform(
            _google_path(line, "candidates", dtype=shape), lambda c: F.coalesce(c["finishReason"], c["finish_reason"])
        ),
        F.array().cast("array<string>"),
    )
    root = _google_path(line, "finishReason", "finish_reason")
    reasons = F.array_distinct(F.array_compact(F.concat(F.array(root), per_candidate)))
    google = F.nullif(F.array_join(F.filter(reasons, lambda r: r != ""), ","), F.lit(""))
    return (
        F.when(provider == "openai", F.try_variant_get(line, "$.response.body.status", "string"))
        .when(provider == "anthropic", F.try_variant_get(line, "$.result.message.stop_reason", "string"))
        .when(provider == "google", google)
    )


def _value(line: Column, path: str) -> Column:
    """The JSON text at ``path``, null for an absent, null or empty value."""
    text = F.to_json(F.variant_get(line, path, "variant"))
    return F.when(text.isin("null", "{}", "[]", '""', "false", "0"), None).otherwise(text)


def result_error(line: Column, provider: Column) -> Column:
    """The error a result line carries, as JSON text, or null."""
    status = F.coalesce(F.try_variant_get(line, "$.response.status_code", "int"), F.lit(200))
    openai = F.coalesce(
        _value(line, "$.error"),
        F.when(status >= 400, F.coalesce(_value(line, "$.response.body"), F.lit("{}"))),
    )
    succeeded = F.coalesce(F.try_variant_get(line, "$.result.type", "string") == "succeeded", F.lit(False))
    anthropic = F.when(
        ~succeeded, F.coalesce(_value(line, "$.result.error"), _value(line, "$.result"), F.lit("{}"))
    )
    return (
        F.when(provider == "openai", openai)
        .when(provider == "anthropic", anthropic)
        .when(provider == "google", _value(line, "$.error"))
    )


def usage_object(line: Column, provider: Column) -> Column:
    """Where each vendor reports token usage, as a variant."""
    return (
        F.when(provider == "openai", F.variant_get(line, "$.response.body.usage", "variant"))
        .when(provider == "anthropic", F.variant_get(line, "$.result.message.usage", "variant"))
        .when(
            provider == "google",
            F.coalesce(
                *[F.variant_get(line, p, "variant") for p in (
                    "$.response.usageMetadata", "$.response.usage_metadata", "$.usageMetadata", "$.usage_metadata")]
            ),
        )
    )


def line_id(line: Column) -> Column:
    """The request id a result line answers."""
    return F.coalesce(*[F.try_variant_get(line, p, "string") for p in ("$.custom_id", "$.key", "$.metadata.key")])


def _asked(manifest: DataFrame, lines: DataFrame) -> tuple[DataFrame, list[str]]:
    """The manifest with one row for each key of a result line, and that key."""
    asked = manifest.drop("messages", "max_tokens")
    if "stage" not in asked.columns:
        return asked, ["custom_id"]
    if "stage" in lines.columns:
        return asked, ["custom_id", "stage"]
    rest = [c for c in asked.columns if c != "custom_id"]
    last = asked.groupBy("custom_id").agg(F.max_by(F.struct(*rest), "stage").alias("__asked"))
    return last.select("custom_id", "__asked.*"), ["custom_id"]


def unreadable_lines(results: DataFrame) -> DataFrame:
    """Gate: result lines that are no JSON."""
    return results.filter(F.col("outcome") == "unreadable")


def normalize_results(lines: DataFrame, manifest: DataFrame, text: str = "value") -> DataFrame:
    """Vendor result lines in one schema, matched to what was asked.

    ``outcome`` is ``merged``, ``error``, ``unknown`` (an id nobody asked for)
    or ``unreadable`` (no JSON; ``text`` is then the line itself). Blank lines
    are skipped. The manifest says which vendor's shape a line has. An id asked
    in several stages counts as asked in its line's stage if lines carry one,
    else in the last.
    """
    filled = lines.filter(F.trim(F.col(text)) != "")
    read = hold(filled, "__line", F.try_parse_json(text)).withColumn("custom_id", line_id(F.col("__line")))
    read = read.withColumn("__raw", F.when(F.col("__line").isNull(), F.col(text)))
    joined = read.drop(text).join(*_asked(manifest, lines), "left")
    line, provider = F.col("__line"), F.col("provider")
    # each step is held, so that none is repeated and the generated code stays small
    shaped = hold(joined, "error", result_error(line, provider))
    good = F.col("error").isNull() & provider.isNotNull()
    shaped = hold(shaped, "text", F.when(good, answer_text(line, provider)).otherwise(""))
    shaped = hold(shaped, "finish_reason", F.when(good, finish_reason(line, provider)))
    shaped = hold(shaped, "__usage", F.when(good, usage_object(line, provider)))
    shaped = hold(shaped, "__counts", usage.usage_counts(F.col("__usage")))
    shaped = hold(shaped, "usage", F.when(good, usage.reckoned(F.col("__counts"))))
    request = (
        F.when(provider == "openai", F.coalesce(
            F.try_variant_get(line, "$.response.request_id", "string"),
            F.try_variant_get(line, "$.response.body.id", "string")))
        .when(provider == "anthropic", F.try_variant_get(line, "$.result.message.id", "string"))
        .when(provider == "google", _google_path(line, "responseId", "response_id"))
    )
    served = F.coalesce(
        F.when(provider == "openai", F.try_variant_get(line, "$.response.body.model", "string"))
        .when(provider == "anthropic", F.try_variant_get(line, "$.result.message.model", "string")),
        F.col("model_id"),
    )
    price = usage.cost_usd(
        F.col("usage"), F.col("price_in"), F.col("price_out"), F.col("price_cached_in"),
        F.col("batch_discount"), F.lit("batch"),
    )
    kept = [c for c in lines.columns if c != text]
    return shaped.select(
        *kept,
        "custom_id", "run_id", "model", "item", "generation", "turn_id", "provider",
        served.alias("served_model"),
        F.lit("batch").alias("run_mode"),
        F.coalesce("__raw", "text").alias("text"),
        F.when(good, request).alias("request_id"),
        "finish_reason",
        "usage",
        F.when(good, price).alias("cost_usd"),
        "error",
        F.when(F.col("__raw").isNotNull(), "unreadable").when(provider.isNull(), "unknown").when(F.col("error").isNotNull(), "error").otherwise("merged").alias("outcome"),
    )


def pad_generations(responses: DataFrame) -> DataFrame:
    """Fill gaps below each item's last generation with empty answers."""
    item = ["run_id", "model", "item"]
    single = F.min("turn_id") == "response"
    full = responses.groupBy(*item).agg(
        F.max("generation").alias("__last"), F.when(single, "response").otherwise("setup").alias("turn_id")
    )
    grid = full.withColumn("generation", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__last"))))
    gaps = grid.join(responses.select(*item, "generation").distinct(), [*item, "generation"], "left_anti")
    return responses.unionByName(gaps.select(*item, "generation", "turn_id", F.lit("").alias("text")))
