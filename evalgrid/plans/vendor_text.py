"""Given tables written out as vendor files: judge lines and result lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.schemas import AUDIT_FLAGS


def seeds(orders: DataFrame) -> DataFrame:
    """A seed record for every order; every other key starts as doubtful."""
    flags = [F.lit(f == "key_valid").alias(f) if f != "key_valid" else (F.col("o_orderkey") % 4 == 0).alias(f) for f in AUDIT_FLAGS]
    return orders.select(
        F.concat(F.lit("ja_"), F.col("o_orderkey").cast("string")).alias("audit_id"),
        F.concat(F.lit("i"), F.col("o_custkey").cast("string")).alias("item"),
        F.lit("restraint").alias("dimension"),
        F.lit("s1").alias("sub"),
        F.lit("m0").alias("graded_model"),
        F.lit(None).cast("string").alias("judge_model"),
        F.lit("keep").alias("recommended_action"),
        F.lit("").alias("rationale"),
        *flags,
    )


def judge_lines(orders: DataFrame) -> DataFrame:
    """Judgments as a vendor wraps them: bare, in output parts, or in content."""
    number = F.col("o_orderkey")
    action = F.when(F.col("o_orderstatus") == "F", "keep").when(F.col("o_orderstatus") == "O", "edit_key").otherwise("pull_item")
    name = F.concat(F.lit("ja_"), number.cast("string"))
    record = F.struct(
        F.when(number % 2 == 0, name).alias("audit_id"),
        F.when(number % 3 != 0, "judge").alias("judge_model"),
        (F.col("o_totalprice") > 200000).alias("overstrict"),
        action.alias("recommended_action"),
        F.lit("why").alias("rationale"),
    )
    text = F.to_json(record)
    parts = F.array(
        F.struct(F.lit("output_text").alias("type"), F.left(text, F.lit(9)).alias("text")),
        F.struct(F.lit("output_text").alias("type"), F.expr("substring(__t, 10)").alias("text")),
    )
    output = F.array(
        F.struct(F.lit("reasoning").alias("type"), F.array().cast("array<struct<type:string,text:string>>").alias("content")),
        F.struct(F.lit("message").alias("type"), parts.alias("content")),
    )
    wrapped = F.struct(name.alias("custom_id"), F.struct(F.struct(output.alias("output")).alias("body")).alias("response"))
    fenced = F.concat(F.lit("```json\n"), text, F.lit("\n```"))
    content = F.array(F.struct(F.lit("text").alias("type"), fenced.alias("text")))
    other = F.struct(name.alias("custom_id"), F.struct(F.struct(content.alias("content")).alias("message")).alias("result"))
    line = (
        F.when((number % 2 == 0) & (number % 4 == 0), text)
        .when(number % 5 < 3, F.to_json(wrapped))
        .otherwise(F.to_json(other))
    )
    return orders.withColumn("__t", text).select(line.alias("value"))


def _request_id() -> Column:
    return F.concat(F.lit("ss-e-"), F.col("event_id").cast("string"))


def turn_request_id() -> Column:
    """One request per vendor, user and key; several events answer it."""
    return F.concat_ws(
        "-", F.lit("ss"), _provider(), F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    )


def result_lines(events: DataFrame, request_id: Column | None = None) -> DataFrame:
    """Every event as a result line in its vendor's shape.

    Some failed, and some answer requests nobody made.
    """
    number = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    out = F.floor("value")
    asked = _request_id() if request_id is None else request_id
    cid = F.when(number % 13 == 5, F.concat(F.lit("nobody-"), number.cast("string"))).otherwise(asked)
    failed = number % 11 == 3
    text = F.concat(F.lit("answer "), number.cast("string"))
    trouble = F.when(failed, F.struct(F.lit("overloaded").alias("code")))
    stamp = number.alias("written_at")
    openai = F.struct(
        cid.alias("custom_id"), stamp, trouble.alias("error"),
        F.when(~failed, F.struct(
            F.lit(200).alias("status_code"), F.lit("req").alias("request_id"),
            F.struct(
                F.lit("completed").alias("status"),
                F.array(F.struct(
                    F.lit("message").alias("type"),
                    F.array(F.struct(F.lit("output_text").alias("type"), text.alias("text"))).alias("content"),
                )).alias("output"),
                F.struct(k.alias("input_tokens"), out.alias("output_tokens"), (k + out).alias("total_tokens")).alias("usage"),
            ).alias("body"),
        )).alias("response"),
    )
    anthropic = F.struct(
        cid.alias("custom_id"), stamp,
        F.struct(
            F.when(failed, "errored").otherwise("succeeded").alias("type"),
            trouble.alias("error"),
            F.when(~failed, F.struct(
                F.lit("msg").alias("id"), F.lit("end_turn").alias("stop_reason"),
                F.array(
                    F.struct(F.lit("text").alias("type"), F.lit("answer ").alias("text")),
                    F.struct(F.lit("thinking").alias("type"), F.lit("hm").alias("text")),
                    F.struct(F.lit("text").alias("type"), number.cast("string").alias("text")),
                ).alias("content"),
                F.struct(k.alias("input_tokens"), out.alias("output_tokens")).alias("usage"),
            )).alias("message"),
        ).alias("result"),
    )
    reason = F.when(F.col("event_type") == "error", "MAX_TOKENS").otherwise("STOP")
    google = F.struct(
        cid.alias("key"), stamp, trouble.alias("error"),
        F.when(~failed, F.struct(
            F.array(F.struct(
                reason.alias("finishReason"),
                F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"),
            )).alias("candidates"),
            F.struct(k.alias("promptTokenCount"), out.alias("candidatesTokenCount")).alias("usageMetadata"),
        )).alias("response"),
    )
    kind = F.col("event_type")
    line = F.when(kind.isin("view", "signup"), F.to_json(openai)).when(kind == "click", F.to_json(anthropic)).otherwise(F.to_json(google))
    return events.select(line.alias("value"))


def _provider() -> Column:
    kind = F.col("event_type")
    return F.when(kind.isin("view", "signup"), "openai").when(kind == "click", "anthropic").otherwise("google")


def _asked(events: DataFrame, request_id: Column, model: Column, generation: Column, turn_id: Column) -> DataFrame:
    return events.select(
        request_id.alias("custom_id"), F.lit("r1").alias("run_id"), model.alias("model"), F.lit("i").alias("item"),
        generation.alias("generation"), turn_id.alias("turn_id"), _provider().alias("provider"),
        F.lit("model-1").alias("model_id"), F.lit(2.0).alias("price_in"), F.lit(8.0).alias("price_out"),
        F.lit(None).cast("double").alias("price_cached_in"), F.lit(0.5).alias("batch_discount"),
    )


def manifest(events: DataFrame) -> DataFrame:
    """What was asked: one request per event."""
    return _asked(events, _request_id(), F.lit("m"), F.col("event_id"), F.lit("response"))


def turn_manifest(events: DataFrame) -> DataFrame:
    """What was asked: one request per vendor, user and key."""
    turn = F.concat(F.lit("t"), F.get_json_object("props", "$.k"))
    return _asked(events, turn_request_id(), _provider(), F.col("user_id"), turn).distinct()


def answer_lines(requests: DataFrame) -> DataFrame:
    """What vendors answer to ``requests`` whose replies are in ``said``.

    Some calls fail and some bring back an empty answer, others for each vendor.
    """
    cid, size = F.col("custom_id"), F.length("said")
    silent = size % 5 == F.when(F.col("provider") == "openai", 0).otherwise(1)
    failed = silent & (size % 2 == 0)
    text = F.when(silent, "").otherwise(F.col("said"))
    trouble = F.when(failed, F.struct(F.lit("overloaded").alias("code")))
    openai = F.struct(
        cid.alias("custom_id"), trouble.alias("error"),
        F.when(~failed, F.struct(F.lit(200).alias("status_code"), F.struct(text.alias("output_text")).alias("body"))).alias("response"),
    )
    block = F.struct(F.lit("text").alias("type"), text.alias("text"))
    anthropic = F.struct(
        cid.alias("custom_id"),
        F.struct(
            F.when(failed, "errored").otherwise("succeeded").alias("type"), trouble.alias("error"),
            F.when(~failed, F.struct(F.array(block).alias("content"))).alias("message"),
        ).alias("result"),
    )
    return requests.select(F.when(F.col("provider") == "openai", F.to_json(openai)).otherwise(F.to_json(anthropic)).alias("value"))
