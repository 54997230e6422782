"""Dates inside ids, provider-safe request ids and audit ids."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date shapes found in model ids and run ids, and the lengths
# of the parts of a request id.
_ID_DATE = r"(20\d{2})-?(0[1-9]|1[0-2])-?(0[1-9]|[12]\d|3[01])"
_RUN_DATE = r"^(\d{4}-\d{2}-\d{2})"
_MODEL_CHARS, _ITEM_CHARS, _TURN_CHARS = 16, 24, 10
_UNSAFE = r"[^A-Za-z0-9_-]+"


def released_from_id(model_id: Column) -> Column:
    """The ISO release date written into a dated model id, or null."""
    parts = [F.regexp_extract(model_id, _ID_DATE, group) for group in (1, 2, 3)]
    return F.when(model_id.rlike(_ID_DATE), F.concat_ws("-", *parts))


def run_date(run_id: Column) -> Column:
    """The ISO date a run id starts with, or null."""
    return F.nullif(F.regexp_extract(run_id, _RUN_DATE, 1), F.lit(""))


def safe_token(value: Column, limit: int) -> Column:
    """``value`` in the safe alphabet, cut to ``limit`` with a digest tail."""
    cleaned = F.btrim(F.regexp_replace(value, _UNSAFE, "_"), F.lit("_"))
    token = F.when(cleaned == "", F.lit("x")).otherwise(cleaned)
    short = F.concat(F.substring(token, 1, limit - 7), F.lit("-"), F.substring(F.sha1(value), 1, 6))
    return F.when(F.length(token) <= limit, token).otherwise(short)


def custom_id(model: Column, item: Column, generation: Column, turn_id: Column) -> Column:
    """The request id of one model, item, generation and turn."""
    return F.concat(
        F.lit("ss-"),
        safe_token(model, _MODEL_CHARS),
        F.lit("-"),
        safe_token(item, _ITEM_CHARS),
        F.lit("-g"),
        generation.cast("string"),
        F.lit("-"),
        safe_token(turn_id, _TURN_CHARS),
    )


def audit_id(*fields: Column) -> Column:
    """The stable id of an audit record, from the text of its key fields."""
    joined = F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    return F.concat(F.lit("ja_"), F.substring(F.sha1(joined), 1, 16))
